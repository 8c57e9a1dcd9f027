"""SentencePiece unigram encoding by Viterbi over a double-array trie, and decoding."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import bound_batches

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
UNK_PENALTY = 10.0
CACHE = 150_000
PART = 1 << 20
LONG = 256
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_BPE = 2
_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
_BOUNDARY = re.compile(f"(?<=[^{MARK}])(?={MARK})|(?=\n)|(?<=\n)")


def _varint(data: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = data[i]
        i += 1
        out |= (c & 127) << shift
        shift += 7
        if c < 128:
            return out, i


def proto_fields(data: bytes):
    """(field number, value) of a protocol-buffer message: ints, or bytes for all other wire types."""
    i = 0
    while i < len(data):
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        else:
            size, i = (8, i) if kind == 1 else (4, i) if kind == 5 else _varint(data, i)
            value = data[i : i + size]
            i += size
        yield key >> 3, value


class DoubleArray:
    """Trie over bytes: from state s, byte c leads to t = base[s] + c if check[t] == s; value[t] is a key's number or -1."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        taken, free = bytearray(size), 1
        taken[0] = 1
        todo = [(0, 0, len(order), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            children = []
            while lo < hi:
                key = keys[order[lo]]
                if len(key) == depth:
                    self.value[state] = order[lo]
                    lo += 1
                    continue
                c, start = key[depth], lo
                while lo < hi and keys[order[lo]][depth] == c:
                    lo += 1
                children.append((c, start, lo))
            if not children:
                continue
            while taken[free]:
                free += 1
            codes = [c for c, _, _ in children]
            at = max(free, codes[0] + 1)
            while True:
                if len(taken) < at + 512:
                    taken.extend(bytes(len(taken)))
                    self._room(len(taken))
                at = taken.find(0, at)
                base = at - codes[0]
                if at >= 0 and not any(taken[base + c] for c in codes):
                    break
                at = at + 1 if at >= 0 else len(taken)
            for c in codes:
                taken[base + c] = 1
            self.base[state] = base
            for c, a, b in children:
                self.check[base + c] = state
                todo.append((base + c, a, b, depth + 1))
        self._room(int(self.base.max()) + 512)

    def _room(self, need: int) -> None:
        while need >= self.check.size:
            self.base = np.concatenate([self.base, np.zeros_like(self.base)])
            self.check, self.value = (np.concatenate([x, np.full_like(x, -1)]) for x in (self.check, self.value))


@dataclass
class PieceModel:
    pieces: list[bytes]
    kinds: np.ndarray
    scores: np.ndarray
    trie: DoubleArray
    byte_ids: np.ndarray
    unk_id: int
    prefix: bool

    def __post_init__(self):
        self._cache: dict[str, bytes] = {}
        live = (self.kinds == _NORMAL) | (self.kinds == _USER)
        self.unk_score = float(self.scores[live].min(initial=0.0)) - UNK_PENALTY
        self.longest = max([1, *(len(p) for p, ok in zip(self.pieces, live) if ok)])
        texts = [p.replace(MARK.encode(), b" ") for p in self.pieces]
        for i, kind in enumerate(self.kinds):
            texts[i] = b"" if kind == _CONTROL else b" \xe2\x81\x87 " if kind == _UNKNOWN else bytes([int(self.pieces[i][3:5], 16)]) if kind == _BYTE else texts[i]
        self.texts = texts

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}

    def __setstate__(self, state):
        self.__dict__ |= state | {"_cache": {}}

    def _fallback(self, char: bytes) -> list[int]:
        return self.byte_ids[list(char)].tolist() if self.byte_ids.size else [self.unk_id]

    def _one(self, data: bytes) -> list[int]:
        """Viterbi over one long segment."""
        base, check, value, scores, n = self.trie.base, self.trie.check, self.trie.value, self.scores, len(data)
        best, back, ids = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int32)
        best[0] = 0
        for i in range(n):
            if best[i] == -np.inf:
                continue
            here, state, first, lone = best[i], 0, i + _char_length(data[i]), False
            for j in range(i, min(n, i + self.longest)):
                nxt = base[state] + data[j]
                if check[nxt] != state:
                    break
                state, v = nxt, value[nxt]
                if v >= 0:
                    lone |= j + 1 == first
                    if here + scores[v] > best[j + 1]:
                        best[j + 1], back[j + 1], ids[j + 1] = here + scores[v], i, v
            if not lone and here + self.unk_score > best[min(n, first)]:
                best[min(n, first)], back[min(n, first)], ids[min(n, first)] = here + self.unk_score, i, -1
        out, at = [], n
        while at:
            out.append([int(ids[at])] if ids[at] >= 0 else self._fallback(data[back[at] : at]))
            at = int(back[at])
        return [x for part in reversed(out) for x in part]

    def _many(self, words: list[bytes]) -> list[list[int]]:
        """Viterbi over many short segments at once, position by position."""
        trie, size = self.trie, np.array([len(w) for w in words])
        n, top = len(words), int(size.max())
        data = np.frombuffer(b"".join(w.ljust(top, b"\0") for w in words), np.uint8).reshape(n, top).astype(np.int32)
        best = np.full((top + 1, n), -np.inf)
        back, ids = np.zeros((top + 1, n), np.int32), np.full((top + 1, n), -1, np.int32)
        best[0] = 0
        lengths = _LENGTHS[data]
        for i in range(top):
            rows = np.flatnonzero((best[i] > -np.inf) & (size > i))
            if not rows.size:
                continue
            first = np.minimum(i + lengths[rows, i], size[rows])
            lone = np.zeros(n, bool)
            live, state, end = rows, np.zeros(rows.size, np.int32), first
            for j in range(i, min(top, i + self.longest)):
                nxt = trie.base[state] + data[live, j]
                ok = (trie.check[nxt] == state) & (size[live] > j)
                live, state, end = live[ok], nxt[ok], end[ok]
                if not live.size:
                    break
                v = trie.value[state]
                hit = v >= 0
                r, v = live[hit], v[hit]
                lone[r[end[hit] == j + 1]] = True
                got = best[i, r] + self.scores[v]
                better = got > best[j + 1, r]
                r = r[better]
                best[j + 1, r], back[j + 1, r], ids[j + 1, r] = got[better], i, v[better]
            bad = ~lone[rows]
            r, e = rows[bad], first[bad]
            got = best[i, r] + self.unk_score
            better = got > best[e, r]
            r, e = r[better], e[better]
            best[e, r], back[e, r], ids[e, r] = got[better], i, -1
        out: list[list[int]] = [[] for _ in words]
        at, rows = size.copy(), np.arange(n)
        steps = []
        while rows.size:
            steps.append((rows, ids[at[rows], rows], back[at[rows], rows], at[rows].copy()))
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        for rows, v, start, stop in reversed(steps):
            for r, x, a, b in zip(rows.tolist(), v.tolist(), start.tolist(), stop.tolist()):
                out[r] += [x] if x >= 0 else self._fallback(words[r][a:b])
        return out

    def _learn(self, segments: set[str]) -> None:
        """Put the ids of segments that are not there yet into the cache."""
        short: dict[int, list[tuple[str, bytes]]] = {}
        for s in segments - self._cache.keys():
            b = s.encode("utf-8", "surrogatepass")
            if len(b) > LONG:
                self._cache[s] = np.array(self._one(b), np.int32).tobytes()
            else:
                short.setdefault(max(8, 1 << (len(b) - 1).bit_length()), []).append((s, b))
        for group in short.values():
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                for (s, _), got in zip(part, self._many([b for _, b in part])):
                    self._cache[s] = np.array(got, np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; None for None. Segments end before runs of the mark and around line feeds, which no piece crosses.

        Texts are worked on in parts of about PART characters, cut between segments, so that memory does not follow the batch.
        """
        out: list[list[bytes] | None] = [None if t is None else [] for t in texts]
        held, size = [], 0

        def flush():
            if len(self._cache) > CACHE:
                self._cache.clear()
            found = [(d, _SEGMENT.findall(part)) for d, part in held]
            self._learn({s for _, part in found for s in part})
            for d, part in found:
                out[d].append(b"".join([self._cache[s] for s in part]))
            held.clear()

        for d, t in enumerate(texts):
            if not t:
                continue
            marked = (MARK + t if self.prefix else t).replace(" ", MARK)
            at = 0
            while at < len(marked):
                m = _BOUNDARY.search(marked, at + PART) if len(marked) - at > PART else None
                end = m.start() if m else len(marked)
                held.append((d, marked[at:end]))
                size += end - at
                at = end
                if size >= PART:
                    flush()
                    size = 0
        flush()
        return [None if part is None else np.frombuffer(b"".join(part), np.int32) for part in out]

    def decode(self, ids) -> str:
        data = b"".join([self.texts[i] for i in ids])
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


def _char_length(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


_LENGTHS = np.array([_char_length(c) for c in range(256)], np.int32)


def load(path: str = MODEL_PATH) -> PieceModel:
    """Read a SentencePiece model file. A BPE model's scores are merge ranks, which become log scores by Zipf's law: -log(1 + rank)."""
    with open(path, "rb") as f:
        return parse(f.read())


def parse(data: bytes) -> PieceModel:
    pieces, kinds, scores, model_type, prefix = [], [], [], 1, True
    for field, value in proto_fields(data):
        if field == 1:
            d = dict(proto_fields(value))
            pieces.append(d[1])
            scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
            kinds.append(d.get(3, _NORMAL))
        elif field == 2:
            model_type = dict(proto_fields(value)).get(3, 1)
        elif field == 3:
            prefix = bool(dict(proto_fields(value)).get(3, 1))
    score, kind = np.array(scores), np.array(kinds)
    if model_type == _BPE:
        score = -np.log1p(np.maximum(0.0, -score))
    mark = MARK.encode()
    live = [i for i in range(len(pieces)) if kind[i] in (_NORMAL, _USER)]
    if any(mark in pieces[i].lstrip(mark) or b"\n" in pieces[i] for i in live):
        raise ValueError("a piece crosses the start of a word or a line")
    trie = DoubleArray([pieces[i] for i in live])
    trie.value = np.where(trie.value >= 0, np.array(live, np.int32)[trie.value], -1)
    byte = {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if kind[i] == _BYTE}
    unk = int(np.flatnonzero(kind == _UNKNOWN)[0]) if (kind == _UNKNOWN).any() else 0
    return PieceModel(pieces, kind, score, trie, np.array([byte[b] for b in range(256)], np.int32) if len(byte) == 256 else np.empty(0, np.int32), unk, prefix)


def encode(spark, model: PieceModel, text: Column | str = "text") -> Column:
    """array<int> of the piece ids of the whole text; null for null, empty for the empty text. The model is broadcast; its size is the vocabulary's."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.encode(texts.tolist()), dtype=object)

    # so that Spark evaluates it once where ids are used several times
    return run.asNondeterministic()(text)


def decode(spark, model: PieceModel, ids: Column | str = "ids") -> Column:
    """The text of piece ids: marks become spaces, byte pieces their bytes, and the space of the added prefix goes."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else shared.value.decode(x))

    return run(ids)


def coding_report(docs, model: PieceModel, id_col: str = "doc_id", text_col: str = "text"):
    """doc_id, n_tokens, ids_hash, round_trip for every row of docs: the size of the encoding, a 64-bit hash of its ids, and
    whether decoding gives the text back, a mark in the text counting as a space. Null texts have null columns.

    Encoding and decoding share one Python worker, which keeps a single copy of the model.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                ids = shared.value.encode(texts)
                cols = [[None if x is None else f(x, t) for x, t in zip(ids, texts)] for f in (lambda x, t: x.size, lambda x, t: xxhash.xxh64_intdigest(x.tobytes()) - 2**63, lambda x, t: shared.value.decode(x) == t.replace(MARK, " "))]
                kinds = (pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_tokens", "ids_hash", "round_trip"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_hash long, round_trip boolean")
