"""Text that was read in a wrong encoding: found and restored by expectation maximisation over latent chains.

A chain says how a record went wrong: written in one encoding and read in another, perhaps twice over. Which chain a
record took is hidden. Every chain is undone as far as its bytes allow, token by token, and what comes out is judged by
a model of character pairs; how often each chain occurs is pooled by source and field. One round computes, for each
record, the posterior of every chain (none being one of them) and re-estimates from all records both the shares of the
chains and the pair model, the latter from the texts as the posteriors say they were. So a single odd letter is weak
evidence in one record, but strong once other records of the source show the same chain.

What may stand behind each token is worked out once: records are stored in chunks that hold their different non-ASCII
tokens, the texts that the chains make of these, and which record has which. A round reads the chunks and computes with
whole arrays: the log P of all those texts, posteriors, and weighted counts. Texts in lower case have many readings, of
which the most probable is chosen; so the chains of other records are settled first, and the pair model with them.

Pair and character counts are hashed into PAIRS and SINGLES cells, whatever the data; only these go to the driver and back.
Shares are kept for each source and field; up to GROUPS of them travel with the tasks, more are joined to the chunks.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.storage import cut, spread, width

PAIRS, SINGLES = 1 << 18, 1 << 14
#: Pairs of source and field whose shares the driver holds, half a kilobyte each.
GROUPS = 1 << 14
#: Records and characters of a chunk.
CHUNK_RECORDS, CHUNK_CHARS = 4096, 1 << 21
#: Cells of a vector that is summed up in one piece.
SLICE = 1 << 12
#: Shares of a round's first guess: a record is garbled, and lost beyond any chain. The first is far too high on
#: purpose: the first pair model was counted on garbled text too and is biased the other way. The second is low, so that
#: a text is not called lost for being rare; both are re-estimated.
GARBLED, LOST = 0.2, 1e-5
#: The rounds end when no share, pooled or of a group, has moved by more.
SETTLED = 1e-3
#: Taken off every count, so that what occurs in one place only does not vouch for itself.
DISCOUNT = 1.0
#: log P of a letter that lower case has changed, where it may also stand for itself.
HIDDEN = -3.5
#: log P of a byte of a multi-byte text that was left without its other half.
TORN, TORN_MARK = -12.0, "�"
#: Records that carry this weight of the pooled share are added to each group of sources.
PRIOR_RECORDS = 50.0
#: Within a garbled record a token may still be sound.
SOUND = 0.1
NONE, LOST_CHAIN, REPLACED = "none", "lost", "replaced"
#: Of a weight that a sum in double precision does not notice, the logarithm.
NOTHING = -40.0

#: Encodings read as another, as (written, read) in Python's names.
STEPS = (
    *[("utf-8", r) for r in "cp1252 cp1251 koi8_r mac_roman cp437 cp850 cp866 cp1253 cp1250 gbk big5 shift_jis euc_kr".split()],
    *[("cp1252", r) for r in "latin_1 cp1251 koi8_r mac_roman cp437 cp850 cp866 cp1253 cp1250".split()],
    *[("cp1251", r) for r in "cp1252 koi8_r mac_roman cp437 cp850 cp866".split()],
    *[("koi8_r", r) for r in "cp1252 cp1251 mac_roman cp437 cp866".split()],
    *[("cp866", r) for r in "cp1252 cp1251 koi8_r".split()],
    *[("cp1253", r) for r in "cp1252 cp1251 mac_roman cp437".split()],
    *[(w, r) for w in "gbk big5 shift_jis euc_jp euc_kr".split() for r in "cp1252 cp1251 mac_roman cp437".split()],
    *[(w, "cp1252") for w in "mac_roman cp437 cp850 cp1255 cp1256 cp874".split()],
)
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {f"{w}>{r}": ((w, r),) for w, r in STEPS} | {
    f"utf-8>{a}>utf-8>{b}": (("utf-8", a), ("utf-8", b)) for a, b in (("cp1252", "cp1252"), ("cp1251", "cp1251"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"))
}
_MULTI = {"utf-8", "gbk", "big5", "shift_jis", "euc_jp", "euc_kr"}


@lru_cache(maxsize=None)
def _table(name: str) -> list[str]:
    """Character of each byte; a byte without one stands for itself, as lenient decoders have it."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


class Codec:
    """Undoes one step (written, read). `folded` texts were put into lower case after the damage."""

    def __init__(self, written: str, read: str):
        self.written, self.read = written, read
        self.widths, self.read_as = (1, 2, 3, 4) if written == "utf-8" else (1, 2), {}
        if read not in _MULTI:
            self.byte = {c: b for b, c in reversed(list(enumerate(_table(read))))} | {chr(b): b for b in range(128)}
            for b in range(128, 160):
                self.byte.setdefault(chr(b), b)
            # what a letter in lower case may have been, as bytes
            self.folded = {c: (b,) for c, b in self.byte.items()}
            for c, b in self.byte.items():
                if len(low := c.lower()) == 1 and low != c and (b > 127 or written in _MULTI and written != "utf-8"):
                    self.folded[low] = tuple(sorted({b, *self.folded.get(low, ())}))
        if written not in _MULTI:
            self.char = _table(written)
            if read not in _MULTI:
                self.direct = {c: self.char[b] for c, b in self.byte.items()}
                self.outcomes = {c: self._ways(c, own) for c, own in self.folded.items()}

    def _ways(self, c: str, own: tuple[int, ...]) -> tuple[tuple[str, float], ...]:
        """What may have stood for a character of a folded text, with the price of each."""
        plain = self.char[self.byte[c]].lower() if c in self.byte else None
        ways = {self.char[b].lower() for b in own}
        return tuple((w, 0.0 if w == plain or plain is None else HIDDEN) for w in sorted(ways))

    def price(self, token: str, before: str) -> float:
        """Of the capitals that undoing a folded token has assumed."""
        if self.written in _MULTI or self.read in _MULTI or len(token) != len(before):
            return 0.0
        return sum(dict(self.outcomes[c]).get(b, 0.0) for c, b in zip(token, before, strict=True) if not c.isascii())

    def encode(self, text: str) -> bytes | None:
        if self.read in _MULTI:
            try:
                return text.encode(self.read)
            except UnicodeEncodeError:
                return None
        try:
            return bytes([self.byte[c] for c in text])
        except KeyError:
            return None

    def undo(self, token: str) -> str | None:
        if self.written not in _MULTI and self.read not in _MULTI:
            try:
                return "".join([self.direct[c] for c in token])
            except KeyError:
                return None
        raw = self.encode(token)
        if raw is None:
            return None
        if self.written in _MULTI:
            try:
                return raw.decode(self.written)
            except UnicodeDecodeError:
                return None
        return "".join([self.char[b] for b in raw])

    def undo_folded(self, token: str, pair: PairModel, inner: Codec | None = None) -> str | None:
        """As `undo`, where each letter may have been a capital; of the ways that decode the most probable."""
        if self.read in _MULTI:
            return self.undo(token)
        try:
            if self.written in _MULTI:
                return self._beam_multi([self.folded[c] for c in token], pair, inner)
            ways = [self.outcomes[c] for c in token]
        except KeyError:
            return None
        beam: list[tuple] = [_START]
        for own in ways:
            if len(own) == 1 and len(beam) == 1 and beam[0][0] == 0.0:  # nothing to choose so far
                beam = [(own[0][1], own[0][0], beam[0])]
                continue
            beam = _best((x[0] + price + pair.step(x[1], c), c, x) for x in beam for c, price in own)
        return _text(_top((x[0] + pair.step(x[1], " "), x[1], x[2]) for x in beam))

    def _sizes(self, lead: int) -> tuple[int, ...]:
        if lead < 0x80:
            return (1,)
        if self.written == "utf-8":
            return (2,) if 0xC2 <= lead < 0xE0 else (3,) if 0xE0 <= lead < 0xF0 else (4,) if 0xF0 <= lead < 0xF5 else ()
        return (1, 2) if self.written == "shift_jis" and 0xA1 <= lead < 0xE0 else (2,)

    def _readings(self, own: tuple[tuple[int, ...], ...]) -> list[str]:
        """The characters that one byte of each of these options in a row may have been."""
        got = self.read_as.get(own)
        if got is None:
            heads = [bytes([b]) for b in own[0] if len(own) in self._sizes(b)]
            for more in own[1:]:
                heads = [h + bytes([b]) for h in heads for b in more if b >= 0x40]
            got = [c for h in heads if (c := _decoded(h, self.written)) is not None]
            if len(self.read_as) < 100_000:
                self.read_as[own] = got
        return got

    def _beam_multi(self, options: list[tuple[int, ...]], pair: PairModel, inner: Codec | None) -> str | None:
        """The most probable text whose bytes are among the options. But for UTF-8, where a torn sequence would prove
        nothing, a byte may have lost its other half, at a price."""
        n, torn, step, memo = len(options), self.written != "utf-8", pair.step, pair.memo
        beams: list[list[tuple]] = [[] for _ in range(n + 1)]
        beams[0] = [_START]
        for i in range(n):
            if not beams[i]:
                continue
            kept = beams[i] = beams[i] if len(beams[i]) == 1 else _best(beams[i])
            for size in self.widths:
                for c in self._readings(tuple(options[i : i + size])) if i + size <= n else ():
                    if inner is None or c in inner.byte:
                        ahead = beams[i + size]
                        for x in kept:
                            known = memo.get((x[1], c))
                            ahead.append((x[0] + (step(x[1], c) if known is None else known), c, x))
            if torn and options[i][0] >= 0x80:
                beams[i + 1] += [(x[0] + TORN, TORN_MARK, x) for x in kept]
        return _text(_top((x[0] + pair.step(x[1], " "), x[1], x[2]) for x in beams[n])) if beams[n] else None


#: The beginning of a way through the choices: log P so far, last character, what came before.
_START = (0.0, "", None)


def _best(ways) -> list[tuple]:
    """The most probable way to each last character: what follows depends on nothing else. The options at a place bound
    their number."""
    best: dict[str, tuple] = {}
    for w in ways:
        old = best.get(w[1])
        if old is None or w[0] > old[0]:
            best[w[1]] = w
    return list(best.values())


def _top(ways) -> tuple:
    """The most probable of all, of equals the one that ends in the smaller character."""
    return min(ways, key=lambda w: (-w[0], w[1]))


def _decoded(head: bytes, written: str) -> str | None:
    """The one character that the bytes stand for."""
    try:
        c = head.decode(written)
    except UnicodeDecodeError:
        return None
    return c if len(c) == 1 else None


def _text(way: tuple) -> str:
    out = []
    while way is not None:
        out.append(way[1])
        way = way[2]
    return "".join(reversed(out))


_CODECS = {step: Codec(*step) for steps in CHAINS.values() for step in steps}
#: The chains by the encoding they were last read in, so that a token is held against its characters once.
_BY_READ: dict[str, list[str]] = {}
for _chain, _steps in CHAINS.items():
    _BY_READ.setdefault(_steps[-1][1], []).append(_chain)


def _readable(token: str, read: str, folded: bool) -> bool:
    if read in _MULTI:
        try:
            return bool(token.encode(read))
        except UnicodeEncodeError:
            return False
    codec = _CODECS[CHAINS[_BY_READ[read][0]][-1]]
    return all(c in (codec.folded if folded else codec.byte) for c in token)


def _wide(token: str) -> bool:
    """Whether bytes of an old multi-byte encoding can lie behind the token: two high bytes, or one that only leads."""
    high = [c for c in token if not c.isascii()]
    return len(high) > 1 or not "\xa0" <= high[0] <= "\xff"


def undo(token: str, chain: str, folded: bool, pair: PairModel) -> str | None:
    """The token before the damage, or None if the chain cannot have made it or changes nothing."""
    text: str | None = token
    steps = CHAINS[chain][::-1]
    for n, step in enumerate(steps):
        if text.isascii():
            return None
        codec = _CODECS[step]
        before = text
        if folded and n == 0:
            text = codec.undo_folded(text, pair, _CODECS[steps[1]] if len(steps) > 1 else None)
        else:
            text = codec.undo(text)
        if text is None or text == before:
            return None
    return text.lower() if folded else text


_NOISE = {c for t in ("cp1252", "latin_1", "mac_roman", "cp437", "cp850") for b in range(128, 256) for c in (_table(t)[b], _table(t)[b].lower())}


#: Place of each chain in a vector of shares; none, lost and replaced follow.
PLACE = {c: i for i, c in enumerate([*CHAINS, NONE, LOST_CHAIN, REPLACED])}
NAMES = list(PLACE)
N_CHAINS = len(CHAINS)


@dataclass
class PairModel:
    """log P of a character after another, from hashed counts."""

    pairs: np.ndarray = field(default_factory=lambda: np.zeros(PAIRS))
    singles: np.ndarray = field(default_factory=lambda: np.zeros(SINGLES))
    memo: dict = field(default_factory=dict)

    def total(self) -> float:
        if "" not in self.memo:
            self.memo[""] = max(1.0, float(self.singles.sum()))
        return self.memo[""]

    def steps(self, codes: np.ndarray) -> np.ndarray:
        """log P of each character of a sequence of code points but the first."""
        prev, cur, total = codes[:-1], codes[1:], self.total()
        before = self.singles[prev % SINGLES].astype(float)
        single = np.maximum(0.0, self.singles[cur % SINGLES] - DISCOUNT) / total
        follow = np.maximum(0.0, self.pairs[_cells(prev, cur)] - DISCOUNT) / np.maximum(before, 1e-300)
        trust = 0.9 * before / (before + 20.0)
        return np.log(trust * np.minimum(1.0, np.where(before > 0, follow, 0.0)) + (1 - trust) * single * 0.95 + 1e-7)

    def scores(self, stream: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log P of texts laid end to end as `_stream` does."""
        if not len(sizes):
            return np.zeros(0)
        return np.add.reduceat(self.steps(stream), np.cumsum(sizes + 1) - sizes - 1)

    def step(self, prev: str, cur: str) -> float:
        got = self.memo.get((prev, cur))
        if got is None:
            a, b = ord(prev or " "), ord(cur)
            before = float(self.singles[a % SINGLES])
            single = max(0.0, float(self.singles[b % SINGLES]) - DISCOUNT) / self.total()
            cell = (a * 0x9E3779B1 ^ b * 0x85EBCA6B) % 0xFFFFFFFB & (PAIRS - 1)
            follow = max(0.0, float(self.pairs[cell]) - DISCOUNT) / before if before > 0 else 0.0
            trust = 0.9 * before / (before + 20.0)
            got = math.log(trust * min(1.0, follow) + (1 - trust) * single * 0.95 + 1e-7)
            if len(self.memo) < 1_000_000:
                self.memo[(prev, cur)] = got
        return got

    def __call__(self, token: str) -> float:
        step, total, prev = self.step, 0.0, " "
        for c in token:
            total += step(prev, c)
            prev = c
        return total + step(prev, " ")

    def noise(self, stream: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log P of texts whose non-ASCII characters are noise, any single byte as Western encodings show it, and whose
        others are drawn one by one."""
        cur = stream[1:]
        plain = np.log(self.singles[cur % SINGLES] / self.total() + 1e-7)
        return np.add.reduceat(np.where(cur < 128, plain, np.where(np.isin(cur, _NOISE_CODES), -5.5, -16.0)), np.cumsum(sizes + 1) - sizes - 1)

    def __getstate__(self):
        return self.pairs.astype(np.float32), self.singles.astype(np.float32)

    def __setstate__(self, state):
        self.pairs, self.singles = state
        self.memo = {}


_NOISE_CODES = np.array(sorted(map(ord, _NOISE)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts without spaces, laid end to end with a space before, between and after; their sizes."""
    return _codes(" " + " ".join(texts) + " ") if texts else np.full(1, 32), np.array([len(t) for t in texts], np.int64)


def _cells(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    mixed = (prev.astype(np.uint64) * np.uint64(0x9E3779B1)) ^ (cur.astype(np.uint64) * np.uint64(0x85EBCA6B))
    return (mixed % np.uint64(0xFFFFFFFB)).astype(np.int64) & (PAIRS - 1)


def _counted(stream: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pair counts, then character counts, of each step of a stream with its weight."""
    pairs = np.bincount(_cells(stream[:-1], stream[1:]), weights, PAIRS)
    return np.r_[pairs, np.bincount(stream[1:] % SINGLES, weights, SINGLES)]


def _repair(token: str, chain: str, folded: bool, pair: PairModel) -> str | None:
    """What the chain makes of a token whose characters it could have left."""
    t = undo(token, chain, folded, pair)
    return t if t and not _CONTROL.search(t) and " " not in t and 2 * t.count(TORN_MARK) < len(t) else None


def _possible(token: str, folded: bool) -> list[str]:
    """The chains that may have made the token, by its characters."""
    wide = _wide(token)
    chains = [c for read, chains in _BY_READ.items() if _readable(token, read, folded) for c in chains]
    return [c for c in chains if wide or CHAINS[c][0][0] not in _MULTI or CHAINS[c][0][0] == "utf-8"]


def _repairs(token: str, folded: bool, pair: PairModel) -> dict[str, str]:
    """What each chain that may have made the token makes of it."""
    made = {c: _repair(token, c, folded, pair) for c in _possible(token, folded)}
    return {c: t for c, t in made.items() if t is not None}


_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f]")


def _price(token: str, text: str, chain: str, folded: bool) -> float:
    """What a repair costs besides its log P."""
    hidden = _CODECS[CHAINS[chain][0]].price(token, text) if folded and len(CHAINS[chain]) == 1 else 0.0
    return TORN * text.count(TORN_MARK) + hidden


def _tokens(text: str) -> list[str]:
    return [t for t in text.replace("\t", " ").split(" ") if t]


@dataclass
class Chunk:
    """Records with their odd tokens: (rec, tok, times) says how often record `rec` has token `tok`; candidate k says
    that chain `chain[k]` makes text `text[k]` of token `tok[k]`."""

    rows: bytes
    folded: bool
    groups: list[tuple[str | None, str]]
    group: np.ndarray
    replaced: np.ndarray
    tokens: tuple[np.ndarray, np.ndarray]
    held: np.ndarray
    texts: tuple[np.ndarray, np.ndarray]
    made: np.ndarray
    price: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, repairs: Callable[[str, bool], list[tuple[int, str, float]]]) -> Chunk:
        """batch: text, source, kind, folded (all alike), and other columns; repairs: (place of the chain, text, price) of
        each repair of a token."""
        texts, sources, kinds = (batch.column(k).to_pylist() for k in range(3))
        folded = bool(batch.num_rows and batch.column(3)[0].as_py())
        number: dict[str, int] = {}
        groups: dict[tuple, int] = {}
        held, group = [], []
        for r, t in enumerate(texts):
            own: dict[int, int] = {}
            for w in _tokens(t):
                if not w.isascii():
                    k = number.setdefault(w, len(number))
                    own[k] = own.get(k, 0) + 1
            held += [(r, k, n) for k, n in own.items()]
            group.append(groups.setdefault((sources[r], kinds[r]), len(groups)))
        made, price, place = [], [], {}
        for w, k in number.items():
            for chain, t, cost in repairs(w, folded):
                made.append((k, chain, place.setdefault(t, len(place))))
                price.append(cost)
        shape = lambda x: np.array(x, np.int32).reshape(-1, 3)
        replaced = np.array(["\ufffd" in t for t in texts], bool)
        kept = pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[4:]], names=[str(k) for k in range(batch.num_columns - 3)])
        ipc = pa.BufferOutputStream()
        with pa.ipc.new_stream(ipc, kept.schema) as out:
            out.write_batch(kept)
        return cls(ipc.getvalue().to_pybytes(), folded, list(groups), np.array(group, np.int32), replaced, _stream(list(number)), shape(held), _stream(list(place)), shape(made), np.array(price))

    def batch(self) -> pa.RecordBatch:
        """text and the other columns."""
        return pa.ipc.open_stream(self.rows).read_next_batch()

    def posteriors(self, pair: PairModel, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Posterior of each chain for each record, given the shares of its group; which candidates are better than
        their token; the tokens' log P."""
        p = pair.scores(*self.tokens)
        tok, chain, text = self.made.T
        q = pair.scores(*self.texts)[text] + self.price
        gain = np.zeros((len(p), N_CHAINS))
        gain[tok, chain] = np.logaddexp(math.log(1 - SOUND) + q, math.log(SOUND) + p[tok]) - p[tok]
        can = np.zeros((len(p), N_CHAINS), bool)
        can[tok, chain] = True
        rec, tok_, times = self.held.T
        starts = np.flatnonzero(np.r_[True, rec[1:] != rec[:-1]])
        as_is = np.add.reduceat(p[tok_] * times, starts)
        lost = np.add.reduceat(np.maximum(p + math.log(SOUND), pair.noise(*self.tokens))[tok_] * times, starts)
        score = np.full((len(self.group), len(PLACE)), -np.inf)
        own = shares[self.group]
        by_chain = np.add.reduceat(gain[tok_] * times[:, None], starts) + as_is[:, None] + np.log(np.maximum(own[:, :N_CHAINS], 1e-9))
        score[:, :N_CHAINS] = np.where(np.logical_or.reduceat(can[tok_], starts), by_chain, -np.inf)
        score[:, PLACE[NONE]] = as_is + np.log(own[:, PLACE[NONE]])
        score[:, PLACE[LOST_CHAIN]] = lost + np.log(np.where(own[:, PLACE[LOST_CHAIN]] > 0, own[:, PLACE[LOST_CHAIN]], LOST))
        score -= score.max(1, keepdims=True)
        weight = np.where(score > NOTHING, np.exp(score), 0.0)
        weight /= weight.sum(1, keepdims=True)
        weight[self.replaced] = np.eye(len(PLACE))[PLACE[REPLACED]]
        return weight, q > p[tok], p

    def counts(self, weight: np.ndarray, better: np.ndarray) -> np.ndarray:
        """Pair and character counts of the odd tokens, as the posteriors say they were."""
        rec, tok_, times = self.held.T
        order = np.argsort(tok_, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(tok_[order]) > 0])
        by = np.add.reduceat(weight[rec[order], : N_CHAINS + 1] * times[order, None], starts)
        tok, chain, text = self.made[better].T
        moved = by[tok, chain]
        sound = by.sum(1) - np.bincount(tok, moved, len(by))
        told = np.bincount(text, moved, len(self.texts[1]))
        return _counted(self.tokens[0], np.repeat(sound, self.tokens[1] + 1)) + (_counted(self.texts[0], np.repeat(told, self.texts[1] + 1)) if len(told) else 0.0)


def restore(text: str, chain: str, folded: bool, pair: PairModel) -> str:
    out = []
    for part in text.split(" "):
        for n, t in enumerate(part.split("\t")):
            r = _repair(t, chain, folded, pair) if not t.isascii() and chain in _possible(t, folded) else None
            better = r is not None and math.log(1 - SOUND) + pair(r) + _price(t, r, chain, folded) > math.log(SOUND) + pair(t)
            out.append(("\t" if n else " " if out else "") + (r if better else t))
    return "".join(out)


def _first_shares() -> np.ndarray:
    return np.array([GARBLED / N_CHAINS] * N_CHAINS + [1 - GARBLED - LOST, LOST, 0.0])


#: The sums of a round: `what` is counts (in slices, the number being `name`), total or group (shares by source and kind).
_SUMS = "what string, name string, kind string, vector binary"


def _summed(rows: DataFrame) -> DataFrame:
    """The vectors of each (what, name, kind) added up, by hash of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for *k, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    if key is not None:
                        yield _sums([(*key, total)])
                    key, total = k, np.zeros(len(v) // 8)
                total = total + np.frombuffer(v)
        if key is not None:
            yield _sums([(*key, total)])

    keys = ["what", "name", "kind"]
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, *keys).sortWithinPartitions(*keys).mapInArrow(run, _SUMS)


def _sums(rows: list[tuple]) -> pa.RecordBatch:
    what, name, kind, vectors = zip(*rows, strict=True) if rows else ((), (), (), ())
    cols = [pa.array(list(c), pa.string()) for c in (what, name, kind)]
    return pa.RecordBatch.from_arrays([*cols, pa.array([v.tobytes() for v in vectors], pa.binary())], names=["what", "name", "kind", "vector"])


def _sliced(what: str, counts: np.ndarray) -> list[tuple]:
    """In slices; those of zeros are left out."""
    return [(what, str(k), "", part) for k in range(0, len(counts), SLICE) if (part := counts[k : k + SLICE]).any()]


def _gathered(sums: dict, what: str) -> np.ndarray:
    out = np.zeros(PAIRS + SINGLES)
    for (w, name, _), v in sums.items():
        if w == what:
            out[int(name) : int(name) + len(v)] = v
    return out


def _collected(summed: DataFrame, groups: bool) -> dict:
    """Sums by key: at most (PAIRS + SINGLES) / SLICE slices of each kind of counts, and GROUPS groups if asked for."""
    t = (summed if groups else summed.where("what <> 'group'")).toArrow()
    return {(w, n, k): np.frombuffer(v) for w, n, k, v in zip(*[c.to_pylist() for c in t.columns], strict=True)}


def _raw(rows: DataFrame) -> dict:
    """Counts of the ASCII tokens (`ascii`), of the odd tokens of plain (`odd`) and of folded texts (`folded`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {w: np.zeros(PAIRS + SINGLES) for w in ("ascii", "odd", "folded")}
        for batch in batches:
            for folded in (False, True):
                texts = [t for t, f in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True) if bool(f) == folded]
                words = [w for t in texts for w in _tokens(t)]
                for odd in (False, True):
                    own = [w for w in words if w.isascii() != odd]
                    if own:
                        stream = _stream(own)[0]
                        total["ascii" if not odd else "folded" if folded else "odd"] += _counted(stream, np.ones(len(stream) - 1))
        yield _sums([x for w, v in total.items() for x in _sliced(w, v)])

    return _collected(_summed(rows.select("text", "source", "kind", "folded").mapInArrow(run, _SUMS)), False)


def _worked_out(token: str, folded: bool, pair: PairModel) -> list[tuple[int, str, float]]:
    return [(PLACE[c], t, _price(token, t, c, folded)) for c, t in _repairs(token, folded, pair).items()]


def _chunk_of() -> Column:
    """Numbers rows by CHUNK_RECORDS neighbours, by fewer the longer their texts: CHUNK_CHARS in a chunk, or one text."""
    spare = F.greatest(F.lit(0), F.ceil(F.log2(F.length("text") * CHUNK_RECORDS / CHUNK_CHARS)))
    bits = F.greatest(F.lit(0), F.lit(CHUNK_RECORDS.bit_length() - 1) - spare).cast("int")
    at = F.monotonically_increasing_id()
    return F.concat_ws("-", bits.cast("string"), F.call_function("shiftright", at, bits).cast("string"))


def _chunks(rows: DataFrame, folded: bool, pair: PairModel) -> DataFrame:
    """id, groups, chunk of the records whose column folded is as given. Every different token is worked out once."""
    rows = rows.where(F.col("folded") == folded)
    words = F.filter(F.split(F.translate("text", "\t", " "), " "), lambda w: w.rlike(r"[^\x00-\x7f]"))
    held = rows.select(F.col("_chunk").alias("id"), F.explode(F.array_distinct(words)).alias("token")).distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pickle.dumps(_worked_out(w, folded, pair)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["token", "made"])

    tokens = held.select("token").distinct().repartition(width(rows.sparkSession), F.xxhash64("token"))
    repairs = cut(tokens.mapInArrow(work, "token string, made binary"), "repairs")
    known = held.join(repairs, "token").select("id", "token", "made")

    def build(own: pa.Table, repaired: pa.Table) -> pa.Table:
        made = dict(zip(repaired.column("token").to_pylist(), map(pickle.loads, repaired.column("made").to_pylist()), strict=True))
        batch = own.drop_columns(["_chunk"]).combine_chunks().to_batches()[0]
        c = Chunk.of(batch, lambda w, _: made[w])
        groups = pa.array([[{"source": s, "kind": k} for s, k in c.groups]], pa.list_(pa.struct([("source", pa.string()), ("kind", pa.string())])))
        return pa.table([own.column("_chunk")[:1].combine_chunks(), groups, pa.array([pickle.dumps(c)], pa.binary())], names=["id", "groups", "chunk"])

    built = rows.groupBy("_chunk").cogroup(known.groupBy("id")).applyInArrow(build, "id string, groups array<struct<source:string,kind:string>>, chunk binary")
    return cut(built, "chunks")


@dataclass
class State:
    """What a round knows: the pair model, pooled shares, and shares by group, as a dictionary or a table."""

    pair: PairModel
    pooled: np.ndarray
    by_group: dict[tuple, np.ndarray] | None = field(default_factory=dict)
    table: DataFrame | None = None

    def shares(self, groups: list[tuple], joined: dict) -> np.ndarray:
        """Counts of each group with PRIOR_RECORDS records of the pooled shares, as shares."""
        known = self.by_group if self.by_group is not None else joined
        got = np.array([known.get((s or "", k or ""), np.zeros(len(PLACE))) for s, k in groups])
        return (got + PRIOR_RECORDS * self.pooled) / (got[:, : REPLACED_AT].sum(1, keepdims=True) + PRIOR_RECORDS)

    def attached(self, chunks: DataFrame) -> DataFrame:
        """chunk, and the sums of its groups if these are a table."""
        if self.table is None:
            return chunks.select("chunk", F.lit(None).cast("array<struct<name:string,kind:string,vector:binary>>").alias("sums"))
        links = chunks.select("id", F.explode("groups").alias("g")).select("id", F.coalesce("g.source", F.lit("")).alias("name"), F.coalesce("g.kind", F.lit("")).alias("kind")).distinct()
        own = links.join(self.table, ["name", "kind"]).groupBy("id").agg(F.collect_list(F.struct("name", "kind", "vector")).alias("sums"))
        return chunks.join(own, "id", "left").select("chunk", "sums")

    def read(self) -> State:
        """For the tasks: without the table."""
        return State(self.pair, self.pooled, self.by_group)


REPLACED_AT = PLACE[REPLACED]


def _open(batches: Iterator[pa.RecordBatch], state: State) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
    for batch in batches:
        for data, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            c = pickle.loads(data)
            joined = {(x["name"], x["kind"]): np.frombuffer(x["vector"]) for x in sums or []}
            weight, better, _ = c.posteriors(state.pair, state.shares(c.groups, joined))
            yield c, weight, better


def _round(chunks: DataFrame, state: State, fixed: np.ndarray) -> State:
    """The state re-estimated: `fixed` are the counts of all tokens that are not in the chunks."""
    now = state.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, groups = np.zeros(PAIRS + SINGLES), {}
        for c, weight, better in _open(batches, now):
            counts += c.counts(weight, better)
            for g, (source, kind) in enumerate(c.groups):
                key = (source or "", kind or "")
                groups[key] = groups.get(key, 0.0) + weight[c.group == g].sum(0)
        if groups:
            yield _sums([*_sliced("counts", counts), ("total", "", "", sum(groups.values())), *[("group", *k, v) for k, v in groups.items()]])

    summed = cut(_summed(state.attached(chunks).mapInArrow(run, _SUMS)), "sums")
    few = summed.where("what = 'group'").count() <= GROUPS
    sums = _collected(summed, few)
    counts = fixed + _gathered(sums, "counts")
    got = sums.get(("total", "", ""), np.zeros(len(PLACE)))
    pooled = (got + PRIOR_RECORDS * _first_shares()) / (got[:REPLACED_AT].sum() + PRIOR_RECORDS)
    by_group = {(n, k): v for (w, n, k), v in sums.items() if w == "group"}
    return State(PairModel(counts[:PAIRS], counts[PAIRS:]), pooled, by_group if few else None, None if few else summed.where("what = 'group'").select("name", "kind", "vector"))


def _moved(before: State, after: State) -> float:
    """The most that a share changed, pooled or, as far as they are in the driver, of a group."""
    most = float(np.abs(before.pooled - after.pooled)[:REPLACED_AT].max())
    keys = list(after.by_group or {})
    if keys and before.by_group is not None:
        most = max(most, float(np.abs(before.shares(keys, {}) - after.shares(keys, {}))[:, :REPLACED_AT].max()))
    return most


def _settled(chunks: DataFrame, state: State, fixed: np.ndarray, rounds: int) -> State:
    for _ in range(rounds):
        before, state = state, _round(chunks, state, fixed)
        if _moved(before, state) <= SETTLED:
            break
    return state


def find_garbled(records: DataFrame, rounds: int = 20) -> DataFrame:
    """The columns of `records` but text, and chain, probability, restored: the records garbled by more odds than not.

    `records` has text, source, kind (the field the text comes from) and folded (whether it was put in lower case
    later), and any other columns. probability is that of any damage, chain the most probable one, `lost` if no
    chain explains it, `replaced` if replacement characters stand for lost ones; restored is null for these two. A garbled part
    makes a record garbled; sound parts are restored to themselves. Null texts and texts of ASCII alone are sound.
    Repeated records are judged one by one; an empty table gives an empty result. The shares are re-estimated until they
    settle, in at most `rounds` rounds for records not folded, and as many for all.
    """
    if rounds < 1:
        raise ValueError("rounds must be positive")
    names = [c for c in records.columns if c not in ("text", "source", "kind", "folded")]
    odd = records.where(F.col("text").rlike(r"[^\x00-\x7f]"))
    rows = odd.select("text", F.col("source").cast("string").alias("source"), F.col("kind").cast("string").alias("kind"), F.coalesce("folded", F.lit(False)).alias("folded"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(names)])
    rows = cut(rows.withColumn("_chunk", _chunk_of()), "texts")
    raw = _raw(spread(rows))
    plain, folded_odd, ascii_ = (_gathered(raw, w) for w in ("odd", "folded", "ascii"))
    start = plain + folded_odd + ascii_
    state = State(PairModel(start[:PAIRS], start[PAIRS:]), _first_shares())
    chunks = None
    for folded, fixed in ((False, ascii_ + folded_odd), (True, ascii_)):
        if (folded_odd if folded else plain).any():
            own = _chunks(rows, folded, state.pair)
            chunks = own if chunks is None else chunks.unionByName(own)
            state = _settled(chunks, state, fixed, rounds)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"_{i} {kinds[f'_{i}']}" for i in range(len(names))], "chain string, probability double, restored string"])
    now = state.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, weight, _ in _open(batches, now):
            take = np.flatnonzero(weight[:, PLACE[NONE]] < 0.5)
            batch = c.batch()
            others = np.delete(weight[take], PLACE[NONE], 1)
            best = [([*NAMES[:N_CHAINS], LOST_CHAIN, REPLACED])[k] for k in others.argmax(1)] if len(take) else []
            restored = [None if b in (LOST_CHAIN, REPLACED) else restore(batch.column(0)[int(i)].as_py(), b, c.folded, now.pair) for i, b in zip(take, best, strict=True)]
            kept = pa.array(take, pa.int64())
            cols = [x.take(kept) for x in batch.columns[1:]] + [pa.array(best, pa.string()), pa.array(1 - weight[take, PLACE[NONE]], pa.float64()), pa.array(restored, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*[f"_{i}" for i in range(len(names))], "chain", "probability", "restored"])

    found = state.attached(chunks).mapInArrow(run, schema) if chunks is not None else rows.sparkSession.createDataFrame([], schema)
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], "chain", "probability", "restored")
