"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from spans that the patterns label in a bounded sample of documents, and from the same
spans written otherwise (an at sign spelled out, a number without its country code), which the patterns miss. Whole texts
are covered by overlapping windows, whose scores are blended where they overlap. Characters that a bound shows to be outside
on the best path are settled by it; over each run of others one Viterbi path is decoded, so the result is the best path
of the whole text, whatever windows a span lies in. Gates are clipped lines and squashing is x / (1 + |x|), which numpy does fast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrspark.llm.common import Reach, as_text, documents
from corrspark.session import cut

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Tried only where a run of digits begins: if it fails there, it fails further on in the run.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Java pattern of texts that may have something to label for training.
LABELLED = "@|[0-9][0-9.() -]{6}"
#: Tags: 0 outside, then begin and inside of each kind.
N_TAGS = 1 + 2 * len(KINDS)
CLASSES = 64
#: Characters of a piece of a long run.
PIECE = 1024
#: Keeps cells whose input gate is shut from decaying to subnormal numbers, which processors are slow with.
TINY = np.float32(1e-15)


@dataclass(frozen=True)
class TaggerRules:
    """``train_docs``: documents expected in the sample for training, drawn by hash from those with digits or an at sign.

    ``train_windows``: windows with spans at most, and twice as many without. ``window``, ``stride``: characters of a window
    and from one to the next, so that two overlap at most. ``hidden``: units for each direction. ``entry``: log-odds taken from
    each step into a span after training, as windows with spans are drawn far more often than they occur. The seed fixes the result.
    """

    train_docs: int = 2000
    train_windows: int = 2000
    window: int = 96
    stride: int = 80
    embed: int = 8
    hidden: int = 8
    steps: int = 400
    batch: int = 64
    rate: float = 0.02
    entry: float = 3.0
    seed: int = 5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, in time linear in the text: only the run before an at sign can begin one."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        low = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
        at = text.find("@", low)


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, by kind, then start."""
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_part_fits, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return found


def written_otherwise(kind: int, span: str, rng: np.random.Generator) -> str:
    """The same data in a form that the patterns do not know."""
    pick = lambda *forms: forms[rng.integers(len(forms))]
    digits = "".join(x for x in span if x.isdigit())
    if kind == 0:
        local, _, domain = span.partition("@")
        return local + pick(" (at) ", "(at)", " [at] ", "[at]", " at ") + domain.replace(".", pick(".", " (dot) ", "(dot)", "[dot]", " dot "))
    if kind == 1:
        return span.replace(".", pick("[.]", "(.)", " . "))
    if kind == 2:
        return pick(".", "/", "_", " . ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own = digits[-10:]
    mark = pick("-", ".", " ", "/")
    return pick(f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}{mark}{own[3:6]}{mark}{own[6:]}", f"00{digits}", f"0{own[:3]}/{own[3:]}")


_AT = re.compile(r"@|[(\[{<]\s*at\s*[)\]}>]|\sat\s", re.IGNORECASE)
_DOT = re.compile(r"\.|[(\[{<]\s*dot\s*[)\]}>]|\sdot\s", re.IGNORECASE)


def plausible(kind: int, span: str) -> bool:
    """Whether a span can be what the network takes it for, however it is written.

    An address has a sign for at, and after it one for a dot; four numbers of an ip are at most 255; a card has 16 to 19 digits that pass Luhn;
    a phone has 8 to 15 digits (two zeros may stand for the plus) of more than two kinds.
    """
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        at = _AT.search(span)
        return bool(at and span[: at.start()].strip() and _DOT.search(span, at.end()))
    if kind == 1:
        numbers = re.findall(r"[0-9]+", span)
        return len(numbers) == 4 and all(len(x) < 4 and int(x) < 256 for x in numbers)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits.removeprefix("00")) <= 15 and len(set(digits)) > 2


def _classes(text: str) -> np.ndarray:
    """A class for each character: digits and letters apart by kind, common marks one by one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.full(128, 1, np.int64)
    for i in range(26):
        table[65 + i], table[97 + i] = 2, 3 + i % 13
    table[48:58] = 20
    for i, c in enumerate(" \n\t@.-_+()%:;,/'\"=&#|<>[]{}!?*$"):
        table[ord(c)] = 21 + i
    return np.where(codes < 128, table[np.minimum(codes, 127)], 62)


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Tagger:
    """The network. Weights are plain arrays, so it travels with a task's function."""

    def __init__(self, rules: TaggerRules):
        self.rules = rules
        rng = np.random.default_rng(rules.seed)
        e, h = rules.embed, rules.hidden
        scaled = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"embed": scaled(CLASSES, e), "out": scaled(2 * h, N_TAGS), "bias": np.zeros(N_TAGS, np.float32), "moves": np.zeros((N_TAGS, N_TAGS), np.float32)}
        for d in "fb":
            self.w[f"x{d}"], self.w[f"h{d}"] = scaled(e, 4 * h), scaled(h, 4 * h)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1
            self.w[f"c{d}"] = bias

    def _lstm(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x: (time, batch, embed), in reading order of the direction."""
        h = self.rules.hidden
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        out = np.zeros((len(x), x.shape[1], h), np.float32)
        state, cell, past = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32), []
        for t in range(len(x)):
            z = pre[t] + state @ self.w[f"h{d}"]
            gates = np.clip(0.25 * z[:, : 3 * h] + 0.5, 0, 1)  # in, forget, out
            new = _soft(z[:, 3 * h :])
            before = cell
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            squashed = _soft(cell)
            if keep:
                past.append((state, before, gates, new, squashed))
            state = gates[:, 2 * h :] * squashed
            out[t] = state
        return out, past

    def _sweep(self, d: str, classes: np.ndarray) -> np.ndarray:
        """(time, hidden, batch) states over (time, batch) classes; as _lstm, with gates in rows and in place."""
        h = self.rules.hidden
        table = np.ascontiguousarray((self.w["embed"] @ self.w[f"x{d}"] + self.w[f"c{d}"]).T)
        across = np.ascontiguousarray(self.w[f"h{d}"].T)
        table[: 3 * h] = 0.25 * table[: 3 * h] + 0.5
        across[: 3 * h] *= 0.25
        out = np.empty((len(classes), h, classes.shape[1]), np.float32)
        state, cell = np.zeros(out.shape[1:], np.float32), np.zeros(out.shape[1:], np.float32)
        z, step = np.empty((4 * h, classes.shape[1]), np.float32), np.empty_like(cell)
        gates, new = z[: 3 * h], z[3 * h :]
        for t in range(len(classes)) if d == "f" else range(len(classes) - 1, -1, -1):
            np.take(table, classes[t], axis=1, out=z, mode="clip")
            z += across @ state
            np.clip(gates, 0, 1, out=gates)
            np.abs(new, out=step)
            step += 1
            new /= step
            cell *= gates[h : 2 * h]
            new *= gates[:h]
            cell += new
            cell += TINY
            np.abs(cell, out=step)
            step += 1
            np.divide(cell, step, out=step)
            state = np.multiply(gates[2 * h :], step, out=out[t])
        return out

    def scores(self, classes: np.ndarray) -> np.ndarray:
        """(time, batch) classes to (time, tags, batch) scores."""
        h = self.rules.hidden
        out = np.ascontiguousarray(self.w["out"].T)
        return np.matmul(out[:, :h], self._sweep("f", classes)) + np.matmul(out[:, h:], self._sweep("b", classes)) + self.w["bias"][:, None]

    def gradients(self, classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the CRF over the batch, and its gradients."""
        w, h = self.w, self.rules.hidden
        n, size = classes.shape[1], classes.shape[0]
        x = w["embed"][classes.T]
        forward, past_f = self._lstm("f", x, True)
        back, past_b = self._lstm("b", x[::-1], True)
        both = np.concatenate([forward, back[::-1]], 2)
        score = both @ w["out"] + w["bias"]
        labels = tags.T
        # the CRF's forward and backward sums
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[0] = score[0]
        for t in range(1, n):
            z = alpha[t - 1][:, :, None] + w["moves"]
            top = z.max(1)
            alpha[t] = score[t] + top + np.log(np.exp(z - top[:, None]).sum(1))
        for t in range(n - 2, -1, -1):
            z = w["moves"] + (score[t + 1] + beta[t + 1])[:, None, :]
            top = z.max(2)
            beta[t] = top + np.log(np.exp(z - top[:, :, None]).sum(2))
        top = alpha[-1].max(1)
        total = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        d_score = np.exp(alpha + beta - total[None, :, None])
        at = np.arange(size)
        gold = sum(score[t, at, labels[t]] for t in range(n)) + sum(w["moves"][labels[t - 1], labels[t]] for t in range(1, n))
        g = {k: np.zeros_like(v) for k, v in w.items()}
        for t in range(1, n):
            g["moves"] += np.exp(alpha[t - 1][:, :, None] + w["moves"] + (score[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
            np.add.at(g["moves"], (labels[t - 1], labels[t]), -1)
        for t in range(n):
            d_score[t, at, labels[t]] -= 1
        g["out"], g["bias"] = np.einsum("tbh,tbk->hk", both, d_score, optimize=True), d_score.sum((0, 1))
        d_both = d_score @ w["out"].T
        d_x = np.zeros_like(x)
        for d, past, d_out in (("f", past_f, d_both[:, :, :h]), ("b", past_b, d_both[::-1, :, h:])):
            inputs = x if d == "f" else x[::-1]
            d_state, d_cell = np.zeros((size, h), np.float32), np.zeros((size, h), np.float32)
            d_inputs = np.zeros_like(x)
            for t in range(n - 1, -1, -1):
                state, before, gates, new, squashed = past[t]
                d_now = d_out[t] + d_state
                d_cell = d_cell + d_now * gates[:, 2 * h :] * (1 - np.abs(squashed)) ** 2
                d_gates = np.concatenate([d_cell * new, d_cell * before, d_now * squashed], 1) * 0.25 * ((gates > 0) & (gates < 1))
                dz = np.concatenate([d_gates, d_cell * gates[:, :h] * (1 - np.abs(new)) ** 2], 1)
                g[f"x{d}"] += inputs[t].T @ dz
                g[f"h{d}"] += state.T @ dz
                g[f"c{d}"] += dz.sum(0)
                d_inputs[t] = dz @ w[f"x{d}"].T
                d_state, d_cell = dz @ w[f"h{d}"].T, d_cell * gates[:, h : 2 * h]
            d_x += d_inputs if d == "f" else d_inputs[::-1]
        np.add.at(g["embed"], classes.T, d_x)
        return float((total - gold).mean()), {k: v / size for k, v in g.items()}

    def fit(self, classes: np.ndarray, tags: np.ndarray) -> list[float]:
        """Adam with a rate that falls to a tenth; the losses."""
        rng, losses = np.random.default_rng(self.rules.seed), []
        first, second = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, self.rules.steps + 1):
            own = rng.integers(0, len(classes), min(self.rules.batch, len(classes)))
            loss, g = self.gradients(classes[own], tags[own])
            size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            rate = self.rules.rate * (1 - 0.9 * step / self.rules.steps)
            for k, v in g.items():
                v = v * min(1, 5 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v**2
                self.w[k] = (self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        self.w["moves"][0, 1:] -= self.rules.entry
        return losses

    def decode(self, scores: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Best tags of each sequence; scores: (batch, time, tags), padded after sizes."""
        by_time = np.ascontiguousarray(scores.transpose(1, 2, 0))
        moves = self.w["moves"]
        n, _, size = by_time.shape
        back = np.zeros((n, N_TAGS, size), np.int8)
        steps = np.empty_like(by_time)
        steps[0] = by_time[0]
        step, better = np.empty((N_TAGS, size), by_time.dtype), np.empty((N_TAGS, size), bool)
        for t in range(1, n):
            top = steps[t]
            if size < 24:  # few sequences: all moves at once
                every = steps[t - 1][:, None] + moves[:, :, None]
                every.argmax(axis=0, out=(best := np.empty((N_TAGS, size), np.int64)))
                back[t] = best
                every.max(axis=0, out=top)
            else:
                np.add(steps[t - 1, 0], moves[0][:, None], out=top)
                for k in range(1, N_TAGS):
                    np.add(steps[t - 1, k], moves[k][:, None], out=step)
                    np.greater(step, top, out=better)
                    np.maximum(top, step, out=top)
                    np.copyto(back[t], k, where=better)
            top += by_time[t]
        path = np.zeros((size, n), np.int8)
        rows = np.arange(size)
        last = steps[sizes - 1, :, rows].argmax(axis=1)
        for t in range(n - 1, -1, -1):
            inside = t < sizes
            path[inside, t] = last[inside]
            last = np.where(inside & (t > 0), back[t, last, rows], last)
        return [path[i, :s] for i, s in enumerate(sizes)]

    def _forward(self, by_time: np.ndarray, now: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
        """Best sums at the last of (time, tags, batch) scores, from ``now`` at the first; fills in the moves taken."""
        moves = self.w["moves"]
        step, better = np.empty_like(now), np.empty(now.shape, bool)
        for t in range(1, len(by_time)):
            top = now[0] + moves[0][:, None]
            for k in range(1, N_TAGS):
                np.add(now[k], moves[k][:, None], out=step)
                if back is not None:
                    np.greater(step, top, out=better)
                    np.copyto(back[t], k, where=better)
                np.maximum(top, step, out=top)
            now = top + by_time[t]
        return now

    def decode_long(self, scores: np.ndarray, size: int = 0) -> np.ndarray:
        """Best tags of one long sequence of (time, tags) scores.

        Pieces are run side by side from each tag that may come before them, then linked by their best ends, and then
        run again from the tag that was chosen.
        """
        size = size or PIECE
        moves, n = self.w["moves"], len(scores)
        count = n // size
        body = np.ascontiguousarray(scores[: count * size].reshape(count, size, N_TAGS).transpose(1, 2, 0))
        value = self._forward(body[:, :, :1], body[0, :, :1])[:, 0].astype(np.float64)
        chosen = np.zeros((count, N_TAGS), np.int64)
        for a in range(1, count, 64):
            own = body[:, :, a : a + 64]
            first = (moves.T[:, None, :] + own[0][:, :, None]).reshape(N_TAGS, -1)
            ends = self._forward(np.repeat(own, N_TAGS, axis=2), first).reshape(N_TAGS, -1, N_TAGS).transpose(1, 2, 0)
            for c, end in enumerate(ends, a):
                every = value[:, None] + end
                chosen[c], value = every.argmax(axis=0), every.max(axis=0)
        path = np.zeros(n, np.int8)
        last = int(value.argmax())
        if count * size < n:
            rest = scores[count * size :, :, None]
            enter = value[:, None] + moves
            back = np.zeros(rest.shape, np.int8)
            tag = int(self._forward(rest, (enter.max(axis=0) + scores[count * size])[:, None], back)[:, 0].argmax())
            for t in range(len(rest) - 1, -1, -1):
                path[count * size + t] = tag
                tag = int(back[t, tag, 0]) if t else tag
            last = int(enter[:, tag].argmax())
        exits = np.zeros(count, np.int64)
        for c in range(count - 1, -1, -1):
            exits[c], last = last, int(chosen[c, last])
        first = body[0].copy()
        first[:, 1:] += moves[exits[:-1]].T
        back = np.zeros(body.shape, np.int8)
        self._forward(body, first, back)
        tags, every = exits, np.arange(count)
        for t in range(size - 1, -1, -1):
            path[t : count * size : size] = tags
            tags = back[t, tags, every]
        return path


def _spans(tags: np.ndarray, start: int) -> list[tuple[int, int, int]]:
    found, kind, begin = [], -1, 0
    for i, tag in enumerate([*tags.tolist(), 0]):
        goes_on = tag and tag % 2 == 0 and (tag - 1) // 2 == kind
        if kind >= 0 and not goes_on:
            found.append((kind, start + begin, start + i))
            kind = -1
        if tag and not goes_on:
            kind, begin = (tag - 1) // 2, i
    return found


def _zones(texts: list[str], tagger: Tagger, most: int = 1200) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, scores) of zones of a stride each, in order; a text's windows begin at its zones and reach into the next."""
    rules = tagger.rules
    over = rules.window - rules.stride
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), -(-sizes // rules.stride))
    first = np.concatenate([[0], np.cumsum(-(-sizes // rules.stride))])
    place = (np.arange(len(owner)) - first[owner]) * rules.stride
    begins = np.concatenate([[0], np.cumsum(sizes)])
    classes = np.concatenate([_classes("".join(texts)), np.zeros(rules.window, np.int64)])
    fade = (np.arange(1, over + 1) / (over + 1)).astype(np.float32)[:, None, None]
    tail = None
    for a in range(0, len(owner), most):
        own, at = owner[a : a + most], place[a : a + most]
        offsets = np.arange(rules.window)[:, None]
        inside = at + offsets < sizes[own]
        scores = tagger.scores(np.where(inside, classes[begins[own] + at + offsets], 0))
        zone = scores[: rules.stride]
        before = np.concatenate([tail if tail is not None else scores[rules.stride :, :, :1], scores[rules.stride :, :, :-1]], axis=2)
        zone[:over] = np.where(at > 0, fade * zone[:over] + (1 - fade) * before, zone[:over])
        tail = scores[rules.stride :, :, -1:].copy()
        yield own, at, zone


def model_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of what the network finds in each text: those of the best path over the whole text.

    ``u`` bounds what a character adds to a stretch of other tags over staying outside. A stretch that gains less than
    ``need`` does not pay. Where the best sum that ends at a character is below ``barrier``, going on from it is worse than
    beginning after it, so it is outside on the best path; only runs between such characters that may pay are decoded.
    """
    stride, moves = tagger.rules.stride, tagger.w["moves"]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts])
    stay = float(moves[0, 0])
    within, enter, leave = float(moves[1:, 1:].max() - stay), float(moves[0, 1:].max() - stay), float(moves[1:, 0].max() - stay)
    need = within - enter - leave - 1e-3
    barrier = within - enter - float((moves[1:, 1:] - moves[0, 1:]).max()) - 1e-3
    barrier = min(barrier, need - 1e-3)
    held, carry, runs = None, 0.0, []
    for owner, place, zones in _zones(texts, tagger):
        if held is not None:
            owner, place = np.concatenate([held[0], owner]), np.concatenate([held[1], place])
            zones = np.concatenate([held[2], zones], axis=2)
        at = place[:, None] + np.arange(stride)
        sizes = lengths[owner][:, None]
        u = (zones[:, 1:].max(axis=1) - zones[:, 0]).T.astype(np.float64) + within
        u[at == 0] += max(0.0, -enter)
        u[at == sizes - 1] += max(0.0, -leave)
        u[at >= sizes] = 0
        u[0, 0] += max(0.0, carry)
        flat_u, first = u.ravel(), (at == 0).ravel()
        first[0] = True
        after = np.cumsum(flat_u)
        before = after - flat_u
        apart = (float(np.ptp(before)) + 1) * np.cumsum(first)  # the least sum is sought within a text only
        best = after - (np.minimum.accumulate(before - apart) + apart)
        outside = (best <= barrier) | (at >= sizes).ravel()
        inside = np.flatnonzero(~outside)
        if len(inside):
            new = np.concatenate([[True], (inside[1:] > inside[:-1] + 1) | first[inside[1:]]])
            starts, stops = inside[new], inside[np.concatenate([new[1:], [True]])] + 1
            most = np.maximum.reduceat(best[inside], np.flatnonzero(new))
        else:
            starts, stops, most = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        keep = len(owner)
        if place[-1] + stride < lengths[owner[-1]]:
            low = int(starts[-1]) if len(stops) and stops[-1] == flat_u.size else flat_u.size
            keep = max(low - 1, 0) // stride  # the character before a run is needed as well
            while len(across := starts[(starts <= keep * stride) & (stops > keep * stride) & (starts > 0)]):
                keep = (int(across[0]) - 1) // stride
            keep = 0 if len(starts) and starts[0] == 0 and stops[0] > keep * stride else keep
        done = (most >= need) & (stops <= keep * stride)
        flat = zones.transpose(2, 0, 1).reshape(-1, N_TAGS) if done.any() else None
        for a, b in zip(starts[done].tolist(), stops[done].tolist(), strict=True):
            text = int(owner[a // stride])
            start = int(place[a // stride]) + a % stride
            pad = int(start > 0), int(start + b - a < lengths[text])
            own = flat[a - pad[0] : b + pad[1]].copy()
            for edge in [0] * pad[0] + [-1] * pad[1]:
                own[edge, 1:] = -1e6  # known to be outside
            runs.append((text, start - pad[0], own))
        held = None if keep == len(owner) else (owner[keep:], place[keep:], zones[:, :, keep:].copy())
        carry = float(best[keep * stride - 1]) if held is not None and keep and place[keep] else carry if held is not None and not keep else 0.0
    runs.sort(key=lambda r: len(r[2]))
    at = 0
    while at < len(runs):
        part = [r for r in runs[at : at + 512] if len(r[2]) <= 16 + 1.3 * len(runs[at][2])]
        at += len(part)
        if len(part[0][2]) > 2 * PIECE:
            paths = [tagger.decode_long(x) for _, _, x in part]
        else:
            sizes = np.array([len(r[2]) for r in part])
            scores = np.zeros((len(part), sizes[-1], N_TAGS), np.float32)
            for own, (_, _, x) in zip(scores, part, strict=True):
                own[: len(x)] = x
            paths = tagger.decode(scores, sizes)
        for (text, start, _), path in zip(part, paths, strict=True):
            if path.any():
                found[text] += _spans(path, start)
    return [sorted(x, key=lambda s: s[1]) for x in found]


def training_windows(texts: list[str], rules: TaggerRules) -> Iterator[tuple[bool, bytes, bytes]]:
    """(has spans, classes, tags) of windows: around each span, as it is and written otherwise, and as many elsewhere."""
    size = rules.window

    def window(text: str, spans: list[tuple[int, int, int]], start: int) -> tuple[bool, bytes, bytes]:
        tags = np.zeros(size, np.uint8)
        for kind, a, b in spans:
            a, b, begins = max(a - start, 0), min(b - start, size), a >= start
            if a < b:
                tags[a:b] = 2 + 2 * kind
                tags[a] = 1 + 2 * kind if begins else 2 + 2 * kind
        classes = np.zeros(size, np.uint8)
        own = _classes(text[start : start + size])
        classes[: len(own)] = own
        return bool(tags.any()), classes.tobytes(), tags.tobytes()

    for text in texts:
        rng = np.random.default_rng([rules.seed, xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"))])
        spans = base_spans(text)
        for kind, a, b in spans:
            yield window(text, spans, max(0, a - int(rng.integers(0, size - min(size - 1, b - a)))))
            for _ in range(2):
                other = written_otherwise(kind, text[a:b], rng)
                near = text[max(0, a - size) : a], text[b : b + size]
                start = max(0, len(near[0]) - int(rng.integers(0, size - min(size - 1, len(other)))))
                around = [(k, x - a + len(near[0]), y - a + len(near[0])) for k, x, y in spans if a - size <= x and y <= a]
                yield window(near[0] + other + near[1], [*around, (kind, len(near[0]), len(near[0]) + len(other))], start)
        digits = [m.start() for m in re.finditer(r"[0-9]+|\(|@", text)][:: max(1, len(text) // 2000)]
        for start in [*(max(0, d - size // 2) for d in digits[:8]), *rng.integers(0, len(text) + 1, 4).tolist()]:
            yield window(text, spans, start)


def train(docs: DataFrame, rules: TaggerRules = TaggerRules()) -> Tagger | None:
    """A tagger from a sample of documents; None if it holds nothing that the patterns label. The driver gets windows only."""
    texts = docs.select("text").where(F.col("text").rlike(LABELLED))
    share = min(1.0, rules.train_docs / max(1, texts.count()))
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 31)) < int(share * (1 << 31)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(training_windows(as_text(batch.column(0)), rules))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["full", "classes", "tags"])

    # few rows of two windows' size each; the sample's size is fixed
    windows = cut(drawn.mapInArrow(run, "full boolean, classes binary, tags binary"), "training-windows")
    ranked = windows.select("full", "classes", "tags", F.xxhash64("classes", "tags").alias("rank"))
    rows = [r for full in (True, False) for r in ranked.where(F.col("full") == full).orderBy("rank", "classes").limit(rules.train_windows * (1 if full else 2)).collect()]
    if not any(r["full"] for r in rows):
        return None
    tagger = Tagger(rules)
    tagger.fit(*(np.stack([np.frombuffer(r[c], np.uint8) for r in rows]).astype(np.int64) for c in ("classes", "tags")))
    return tagger


def _parts(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; a longer text is a range of its own."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        if i > start and held + len(x) > most:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield start, len(texts)


FIELDS = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_model", T.LongType())]


def find_personal_data(docs: DataFrame, rules: TaggerRules = TaggerRules()) -> DataFrame:
    """One row for each row of ``docs``: doc_id and FIELDS; positions are code points, ends exclusive.

    Spans of the network that touch one of the patterns, or cannot be what they are taken for (see plausible()), are dropped;
    base ones stay. A null or empty text has no spans; very long ones are searched whole; repeated rows and null ids are searched row by row. Where the sample labels nothing, only the
    patterns are used. An empty table gives an empty table. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, rules))  # a few thousand weights

    def show(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            texts = as_text(batch.column(1))
            base = [base_spans(t) for t in texts]
            tagged = [x for a, b in _parts(texts) for x in model_spans(texts[a:b], tagger)] if tagger else [[] for _ in texts]
            rows = []
            for text, own, more in zip(texts, base, tagged, strict=True):
                reach = Reach([(a, b) for _, a, b in own])
                new = [x for x in more if reach.to(x[2] - 1) <= x[1] and plausible(x[0], text[x[1] : x[2]])]
                kinds = [k for k, _, _ in own]
                rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(show(own).encode()).hexdigest(), show(sorted(own + new)), len(new)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in FIELDS]
            arrays = [pa.array(c, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for c, f in zip(columns, FIELDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *(f.name for f in FIELDS)])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], *FIELDS]))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
