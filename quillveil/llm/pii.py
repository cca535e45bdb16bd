"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions.

Base spans are the leftmost matches of four patterns that pass their checks (`base_spans`). The network, trained in numpy on
labelled spans that `examples` makes from a seed, adds spans that the patterns don't reach: phone numbers without a plus sign,
spelled-out addresses and the like. Overlapping windows read it on a grid over the text; their emissions are averaged where
windows overlap, and one Viterbi pass over a region decodes them together. No span that passes its kind's check lies outside the
runs of digits and what may stand between them, or the words and address-like runs, of any length, round at signs, so only the
windows that read a character of those are run. A decoded piece of an address run stands for the whole of it. A decoded span
must pass its kind's check and must not overlap a base span.

Edge cases: null and empty texts have no spans; offsets are code points, ends exclusive; long texts are read whole; spans of
different kinds may overlap among the base spans; repeated rows have equal spans; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillveil.llm.workers import lean

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # other; then first and later characters of each kind
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NEEDED = re.compile(r"[0-9@]|[\[(] ?at ?[\])]", re.I)
_NOT_DIGIT = re.compile("[^0-9]")


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in text.split("."))


def _is_card(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str):
    """Leftmost matches of local part, at sign, domain; each at sign is met once, so runs of any length take linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1  # a local part cannot hold this at sign
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by start, then kind."""
    if not _NEEDED.search(text):
        return []
    spans = [Span(a, 0, b) for a, b in _emails(text)]
    spans += [Span(m.start(), 1, m.end()) for m in _IP.finditer(text) if _is_ip(m[0])]
    spans += [Span(m.start(), 2, m.end()) for m in _CARD.finditer(text) if _is_card(m[0])]
    spans += [Span(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(spans)


# The network.

_SYMBOLS = "abcdefghijklmnopqrstuvwxyz@.-_+%()[] \n/:,='\"#"
_CODE = np.full(0x250, len(_SYMBOLS) + 2, np.int64)
for _i, _c in enumerate(_SYMBOLS):
    _CODE[ord(_c)] = _i + 1
    _CODE[ord(_c.upper())] = _i + 1
_CODE[ord("0") : ord("9") + 1] = len(_SYMBOLS) + 1
CODES = len(_SYMBOLS) + 3  # 0 pads
SPAN, STRIDE = 64, 32


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.minimum(points, len(_CODE) - 1)]


class Network(NamedTuple):
    embed: np.ndarray
    forward: np.ndarray  # inputs, states and one, to gates
    backward: np.ndarray
    out: np.ndarray
    moves: np.ndarray


def _lstm(x: np.ndarray, w: np.ndarray, keep: bool = False):
    """States (time, batch, hidden) of a gate order input, forget, output, candidate."""
    steps, batch, inputs = x.shape
    hidden = w.shape[1] // 4
    halved = w * np.repeat(np.array((0.5, 0.5, 0.5, 1), w.dtype), hidden)  # a sigmoid is a tanh of half its argument
    gates = (x.reshape(-1, inputs) @ halved[:inputs] + halved[-1]).reshape(steps, batch, 4 * hidden)
    recurrent = halved[inputs:-1]
    states, cells, bent = (np.zeros((steps + 1, batch, hidden), w.dtype) for _ in range(3))
    fed, held = np.empty((batch, 4 * hidden), w.dtype), np.empty((batch, hidden), w.dtype)
    for t in range(steps):
        z, c = gates[t], cells[t + 1]
        z += np.matmul(states[t], recurrent, out=fed)
        np.tanh(z, out=z)
        opened = z[:, : 3 * hidden]
        opened *= 0.5
        opened += 0.5
        np.multiply(z[:, hidden : 2 * hidden], cells[t], out=c)
        c += np.multiply(z[:, :hidden], z[:, 3 * hidden :], out=held)
        np.tanh(c, out=bent[t + 1])
        np.multiply(z[:, 2 * hidden : 3 * hidden], bent[t + 1], out=states[t + 1])
    return (states[1:], (states[:-1], cells[:-1], gates, bent[1:])) if keep else states[1:]


def _lstm_gradient(x: np.ndarray, w: np.ndarray, kept: tuple[np.ndarray, ...], d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, batch, inputs = x.shape
    hidden = w.shape[1] // 4
    states, cells, gates, bent = kept
    i, f, o, g = (gates[:, :, k * hidden : (k + 1) * hidden] for k in range(4))
    by_cell = np.stack((g * i * (1 - i), cells * f * (1 - f), i * (1 - g * g)), 2)
    by_state, through = bent * o * (1 - o), o * (1 - bent * bent)
    dz = np.empty((steps, batch, 4, hidden), w.dtype)
    dh, dc = np.zeros((batch, hidden), w.dtype), np.zeros((batch, hidden), w.dtype)
    back = np.ascontiguousarray(w[inputs:-1].T)
    for t in range(steps - 1, -1, -1):
        dh += d[t]
        dc += dh * through[t]
        z = dz[t]
        np.multiply(dc[:, None], by_cell[t, :, :2], out=z[:, :2])
        np.multiply(dh, by_state[t], out=z[:, 2])
        np.multiply(dc, by_cell[t, :, 2], out=z[:, 3])
        dh = z.reshape(batch, -1) @ back
        dc *= f[t]
    flat = dz.reshape(-1, 4 * hidden)
    dw = np.concatenate((x.reshape(-1, inputs).T @ flat, states.reshape(-1, hidden).T @ flat, flat.sum(0, keepdims=True)))
    return (flat @ w[:inputs].T).reshape(steps, batch, inputs), dw


def emissions(net: Network, windows: np.ndarray) -> np.ndarray:
    """Scores (windows, characters, tags)."""
    x = net.embed[windows.T]
    both = np.concatenate((_lstm(x, net.forward), _lstm(x[::-1], net.backward)[::-1]), axis=2)
    return (both @ net.out[:-1] + net.out[-1]).transpose(1, 0, 2)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of each of (batch, time, tags)."""
    batch, steps, _ = scores.shape
    best, back = scores[:, 0], np.empty((steps, batch, TAGS), np.int8)
    for t in range(1, steps):
        both = best[:, :, None] + moves
        back[t] = both.argmax(1)
        best = both.max(1) + scores[:, t]
    tags = np.empty((batch, steps), np.int8)
    tags[:, -1] = best.argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t][rows, tags[:, t]]
    return tags


def allowed_moves() -> np.ndarray:
    """0 where a tag may follow another, else a large negative number: later characters only follow their own kind."""
    moves = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        moves[:, 2 + 2 * k] = -1e4
        moves[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return moves


def _crf_gradient(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood a window, and its gradients by scores (time, batch, tags) and moves."""
    steps, batch, _ = scores.shape
    highest = scores.max(2)
    e, m = np.exp((scores - highest[:, :, None]).astype(np.float64)), np.exp(moves.astype(np.float64))
    a, b, c = np.empty_like(e), np.ones_like(e), np.empty((steps, batch, 1))  # shares of the paths up to t and from it, and their scale
    for t in range(steps):
        a[t] = (a[t - 1] @ m) * e[t] if t else e[t]
        c[t] = a[t].sum(1, keepdims=True)
        a[t] /= c[t]
    e /= c
    for t in range(steps - 2, -1, -1):
        b[t] = (e[t + 1] * b[t + 1]) @ m.T
    d = a * b
    dm = m * (a[:-1].reshape(-1, TAGS).T @ (e[1:] * b[1:]).reshape(-1, TAGS))
    at = np.arange(steps)[:, None], np.arange(batch)[None, :], tags.T
    gold = scores[at].sum() + moves[tags[:, :-1], tags[:, 1:]].sum()
    d[at] -= 1
    np.subtract.at(dm, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    return float(np.log(c).sum() + highest.sum() - gold) / batch, (d / batch).astype(scores.dtype), (dm / batch).astype(moves.dtype)


def examples(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: made-up words with personal data of many formats, and numbers that are none."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick(("an", "er", "the", "ion", "st", "ing", "é", "sch", "que", "or", "ü", "a", "do", "ll", "en")) for _ in range(rng.integers(1, 4)))

    def card() -> str:
        own = pick("3456") + digits(14)
        last = next(str(d) for d in range(10) if luhn(own + str(d)))
        own += last
        return pick(("", " ", "-")).join(own[i : i + 4] for i in range(0, 16, 4))

    def item() -> tuple[int, str]:
        kind = int(rng.integers(0, 7))
        sep = pick(("-", ".", " "))
        host = f"{pick((word(), 'mail' + digits(1)))}.{pick(('com', 'org', 'net', 'example.com'))}"
        if kind == 0:
            name = pick((word(), f"{word()}.{word()}", word() + digits(2), digits(2))).replace("é", "e").replace("ü", "u")
            at, dot = pick((("@", "."), ("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) ")))
            return kind, name + at + host.replace("é", "e").replace("ü", "u").replace(".", dot)
        if kind == 1:
            return kind, ".".join(str(x) for x in rng.integers(0, 256, 4))
        if kind == 2:
            return kind, card()
        if kind == 3:
            area, a, b = digits(3), digits(3), digits(4)
            return kind, pick((f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}{sep}{a}{sep}{b}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"00{digits(2)} {digits(3)} {digits(7)}", f"+{digits(11)}"))
        return -1, pick((f"version {digits(1)}.{digits(1)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", digits(int(rng.integers(1, 9))), f"{digits(2)}/{digits(2)}/20{digits(2)}", f"{digits(2)}.{digits(3)},{digits(2)}", f'"{rng.bytes(10).hex()}"', f"{digits(1)}.{digits(2)}.{digits(1)}", f"{word()} (at) {word()}", f"{digits(3)}-{digits(2)}", f"{digits(2)}:{digits(2)}"))

    xs, ys = np.zeros((n, SPAN), np.int64), np.zeros((n, SPAN), np.int64)
    for i in range(n):
        text, tags = "", []
        while len(text) < SPAN + 24:
            if rng.random() < 0.35:
                kind, own = item()
                text += own
                tags += [0] * len(own) if kind < 0 else [1 + 2 * kind] + [2 + 2 * kind] * (len(own) - 1)
            else:
                own = pick((word(), word().capitalize()))
                text += own
                tags += [0] * len(own)
            gap = pick((" ", " ", " ", ". ", ", ", "\n", " | "))
            text += gap
            tags += [0] * len(gap)
        a = int(rng.integers(0, 24))
        xs[i], ys[i] = codes(text[a : a + SPAN]), tags[a : a + SPAN]
        if ys[i, 0] and ys[i, 0] % 2 == 0:  # a span that the window cuts
            ys[i, 0] -= 1
    return xs, ys


@lru_cache(2)
def train(seed: int = 7, hidden: int = 24, size: int = 16, steps: int = 400, batch: int = 96) -> Network:
    """The network after `steps` Adam steps; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    new = lambda *shape: (rng.standard_normal(shape) * 0.5 / np.sqrt(shape[0])).astype(np.float32)
    net = [new(CODES, size) * 2, new(size + hidden + 1, 4 * hidden), new(size + hidden + 1, 4 * hidden), new(2 * hidden + 1, TAGS), allowed_moves()]
    for w in net[1:3]:
        w[-1] = 0
        w[-1, hidden : 2 * hidden] = 1
    fixed = net[4] < -1e3
    mean, square = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net]
    xs, ys = examples(4000, rng)
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(xs), batch)
        ids, tags = xs[rows].T, ys[rows]
        x = net[0][ids]
        one, kept_one = _lstm(x, net[1], True)
        two, kept_two = _lstm(x[::-1], net[2], True)
        both = np.concatenate((one, two[::-1]), axis=2)
        scores = both @ net[3][:-1] + net[3][-1]
        _, ds, dm = _crf_gradient(scores, net[4], tags)
        dm[fixed] = 0
        flat = ds.reshape(-1, TAGS)
        dout = np.concatenate((both.reshape(len(flat), -1).T @ flat, flat.sum(0, keepdims=True)))
        db = ds @ net[3][:-1].T
        dx1, dw1 = _lstm_gradient(x, net[1], kept_one, db[:, :, :hidden])
        dx2, dw2 = _lstm_gradient(x[::-1], net[2], kept_two, db[::-1, :, hidden:])
        de = np.zeros_like(net[0])
        np.add.at(de, ids.ravel(), (dx1 + dx2[::-1]).reshape(-1, size))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for w, g, m, s in zip(net, (de, dw1, dw2, dout, dm), mean, square, strict=True):
            g = np.clip(g, -5, 5)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Network(*net)


_AT = re.compile(r"@|[\[(] ?at ?[\])]", re.I)
_RUN = re.compile(r"[0-9][0-9 ().+/-]*")
#: An address may be spelled out, with or without blanks: local part before the at sign (matched backwards), host after it.
_DOT = r"\s*[\[(] ?dot ?[\])]\s*"
_BEFORE = re.compile(r"\s*+[\w.%+-]++(?:\s*[\])] ?tod ?[\[(]\s*[\w.%+-]++)*+", re.I)
_AFTER = re.compile(rf"\s*+[\w-]++(?:(?:\.|{_DOT})[\w-]++)*+", re.I)
_ADDRESS = re.compile(rf"[\w.%+-]++(?:{_DOT}[\w.%+-]++)*+\s*+(?:{_AT.pattern})\s*+[\w-]++(?:(?:\.|{_DOT})[\w-]++)++", re.I)
#: A decoded address without that form has so many words at most.
WORDS = 6


def address_runs(text: str) -> list[tuple[int, int, int, int]]:
    """Each at sign's ends, and those of the local part and the host round it."""
    out, backwards = [], ""
    for m in _AT.finditer(text):
        backwards = backwards or text[::-1]
        before, after = _BEFORE.match(backwards, len(text) - m.start()), _AFTER.match(text, m.end())
        out.append((*m.span(), len(text) - before.end() if before else m.start(), after.end() if after else m.end()))
    return out


def cores(text: str) -> list[tuple[int, int]]:
    """Ranges that every span that passes lies in: runs of digits and what may stand between them, and round each at sign its
    address run and as many words as an address of another form can have."""
    out = [(max(0, m.start() - 1), m.end()) for m in _RUN.finditer(text)]
    if runs := address_runs(text):
        words = [m.span() for m in re.finditer(r"\S+", text)]
        starts = [w[0] for w in words]
        for a, b, x, y in runs:
            i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
            out.append((min(x, words[max(0, i - WORDS + 1)][0]), max(y, words[min(len(words), j + WORDS) - 1][1])))
    return sorted(out)


def regions(text: str) -> list[tuple[int, int]]:
    """The cores with every window of the whole text's grid that reads one of their characters, joined where they meet.

    So the cores' emissions are those of windows over the whole text.
    """
    out: list[tuple[int, int]] = []
    for a, b in cores(text):
        a, b = max(0, a // STRIDE * STRIDE - STRIDE), min(len(text), (b - 1) // STRIDE * STRIDE + SPAN)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPELLED = re.compile(r".+(?:@|[\[(] ?at ?[\])]).+(?:\.|[\[(] ?dot ?[\])]).+", re.I | re.S)


def _passes(kind: int, text: str) -> bool:
    if kind == 0:
        if len(text) < 6 or _SPELLED.fullmatch(text) is None:
            return False
        return len(text.split()) <= WORDS or _ADDRESS.fullmatch(text) is not None
    if kind == 1:
        return _IP.fullmatch(text) is not None and _is_ip(text)
    if kind == 2:
        return _CARD.fullmatch(text) is not None and _is_card(text)
    return re.fullmatch(r"[+(]?[0-9][ ().0-9/-]*[0-9]", text) is not None and 9 <= len(_NOT_DIGIT.sub("", text)) <= 15 and len(re.split(r"[ ().\-/]+", text.strip("(+"))) >= 3


def added_spans(net: Network, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """Spans that the network finds beside the base spans of each text."""
    places = [(i, a, b) for i, t in enumerate(texts) for a, b in regions(t)]
    places.sort(key=lambda p: p[2] - p[1])
    out: list[list[Span]] = [[] for _ in texts]
    addresses: dict[int, list[Span]] = {}
    at = 0
    while at < len(places):
        widest, group = 0, []
        while at < len(places) and (not group or (len(group) < 512 and max(widest, places[at][2] - places[at][1]) * (len(group) + 1) <= 1 << 16)):
            group.append(places[at])
            widest = places[at][2] - places[at][1]
            at += 1
        count = -(-widest // STRIDE)  # every character has the window that starts before it and the one before that
        padded = np.zeros((len(group), STRIDE * (count + 1)), np.int64)
        for r, (i, a, b) in enumerate(group):
            padded[r, : b - a] = codes(texts[i][a:b])
        windows = np.stack([padded[:, STRIDE * j : STRIDE * j + SPAN] for j in range(count)], 1).reshape(-1, SPAN)
        used = np.flatnonzero(windows.any(1))
        scores = np.zeros((len(windows), SPAN, TAGS), np.float32)
        for k in range(0, len(used), 512):
            scores[used[k : k + 512]] = emissions(net, windows[used[k : k + 512]])
        scores = scores.reshape(len(group), count, SPAN, TAGS)
        total = np.zeros((len(group), padded.shape[1], TAGS), np.float32)
        cover = np.zeros(padded.shape[1], np.float32)
        for j in range(count):
            total[:, STRIDE * j : STRIDE * j + SPAN] += scores[:, j]
            cover[STRIDE * j : STRIDE * j + SPAN] += 1
        tags = viterbi(total / cover[None, :, None], net.moves)
        tags[padded == 0] = 0
        for r in np.flatnonzero(tags.any(1)):
            i, a, _ = group[r]
            own = tags[r]
            begins = np.flatnonzero(own % 2 == 1)
            for s in begins:
                e = s + 1
                while e < len(own) and own[e] == own[s] + 1:
                    e += 1
                text = texts[i][a + s : a + e]
                start = a + int(s) + len(text) - len(text.lstrip())
                text = text.strip().rstrip(".,")
                spans = [Span(start, int(own[s]) // 2, start + len(text))]
                if own[s] == 1:  # addresses are taken whole, whatever part of them was decoded
                    if i not in addresses:
                        addresses[i] = [Span(x, 0, y) for *_, x, y in address_runs(texts[i]) if _ADDRESS.fullmatch(texts[i], x, y)]
                    first, last = bisect_right(addresses[i], start, key=lambda x: x.end), bisect_left(addresses[i], start + len(text), key=lambda x: x.start)
                    spans = addresses[i][first:last] or spans
                for span in spans:
                    if text and _passes(span.kind, texts[i][span.start : span.end]) and span not in out[i] and not any(x.start < span.end and span.start < x.end for x in base[i]):
                        out[i].append(span)
    return out


def _both(net: Network, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    fixed = [base_spans(t) for t in texts]
    return [(a, sorted(a + b) if b else a) for a, b in zip(fixed, added_spans(net, texts, fixed), strict=True)]


def find(df: DataFrame, text: str = "text", spans: str = "spans", base: str = "base_spans") -> DataFrame:
    """df with columns `base` and `spans` (base and added): arrays of structs kind, start, end, by start, then kind."""
    names = [c for c in df.columns if c not in (spans, base)]
    shared = df.sparkSession.sparkContext.broadcast(train())  # some 10,000 numbers
    item = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(base, item), T.StructField(spans, item)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def column(rows: list[list[Span]]) -> pa.Array:
        return pa.array([[{"kind": KINDS[s.kind], "start": s.start, "end": s.end} for s in r] for r in rows], arrow)

    def run(batches):
        for batch in batches:
            found = _both(shared.value, [t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], column([a for a, _ in found]), column([b for _, b in found])], names=[*names, base, spans])

    return df.select(F.col(text).cast("string").alias("\0text"), *(F.col(f"`{c}`") for c in names)).mapInArrow(lean(run), schema)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or each group of overlapping ones, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the personal data in `text` masked; a null text stays null."""
    names = df.columns
    shared = df.sparkSession.sparkContext.broadcast(train())

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 1000):
                columns = dict(zip(names, (c.slice(a, 1000) for c in batch.columns), strict=True))
                texts = columns[text].to_pylist()
                found = _both(shared.value, [t or "" for t in texts])
                values = [t if not s else mask(t, [(KINDS[x.kind], x.start, x.end) for x in s]) for t, (_, s) in zip(texts, found, strict=True)]
                columns[text] = pa.array(values, pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return df.mapInArrow(lean(run), df.schema)
