"""Operator 9: sampled SentencePiece segmentations by forward filtering and backward sampling.

A text is cut before spaces, around newlines and between words and signs, but not beside the characters by which
pieces of the vocabulary join words and signs (the underscore, mostly). So no piece crosses a cut, every piece can
be drawn, and the lattice of a text is the chain of its chunks' lattices. Forward filtering sums the weights of all segmentations
up to each place of a distinct chunk once; backward sampling then walks from the ends of all chunk
occurrences of a batch at once, drawing the last piece in proportion to its share. Draws are a hash
of the row's key, the chunk's number and the step, so a row always gets the same sample.

A piece of rank r weighs exp(-alpha * log(r + 2)); characters outside the vocabulary, and the
meta symbol itself, are their UTF-8 bytes' pieces, so decoding gives back every text exactly.

Cases: null texts have a null list, empty texts an empty one. Rows of equal key and text are equal;
a null key counts as 0. Chunks of any length are handled; memory is that of a batch of texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm.common import documents, map_rows

ALPHA = 1.0
META = "▁"
#: A task keeps lattices of distinct chunks of so many characters.
TASK_CHARS = 2_000_000
SLOT_BITS = 20
#: The log-weight of a character by its bytes.
BYTES_WEIGHT = -14.0


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunk_pattern(names: list[str]) -> re.Pattern:
    """Where texts may be cut, so that none of the names is: spaces go with what follows; words and signs part unless a joining character is beside."""
    sort = lambda c: 0 if c == " " else 1 if re.match(r"\w", c) else 2
    joining = {"_"}
    for name in names:
        for a, b in zip(name, name[1:]):
            if sort(a) and sort(b) and sort(a) != sort(b) and not joining & {a, b}:
                joining.add(a if sort(a) == 1 else b)
    own = "".join(map(re.escape, sorted(joining)))
    run = rf"[^\W{own}]+|[^\w \n{own}]+"
    return re.compile(rf" *(?:{run}|(?=[{own}]))(?:[{own}]+(?:{run})?)*|\n| +")


class Pieces:
    """Vocabulary and weights of a SentencePiece model with byte pieces."""

    def __init__(self, path: str, alpha: float = ALPHA) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = set(self.byte) | {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        names = {i: sp.id_to_piece(i) for i in range(n) if i not in special}
        self.bytes = {i: name.replace(META, " ").encode() for i, name in names.items()} | {i: bytes([b]) for b, i in enumerate(self.byte)}
        # The meta symbol stands for a space; in a text it is itself, and spelled in bytes.
        own = {i: name.replace(META, " ") for i, name in names.items() if "\n" not in name and " " not in name}
        self.chunk = chunk_pattern(list(own.values()))
        self.longest = max(map(len, own.values()))
        self.tables = []
        for k in range(1, self.longest + 1):
            found = [(i, name) for i, name in own.items() if len(name) == k]
            cp = np.array([[ord(c) for c in name] for _, name in found], np.uint64).reshape(-1, k)
            keys = rolled(cp)
            ids = np.array([i for i, _ in found], np.int32)
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            slots = np.zeros(1 << SLOT_BITS, bool)
            slots[(keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = True
            self.tables.append((keys, ids, -alpha * np.log(ids + 2.0), slots))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")


def rolled(cp: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points."""
    out = np.zeros(len(cp), np.uint64)
    for k in range(cp.shape[1]):
        out = roll(out, cp[:, k])
    return out


def roll(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    h = (h + cp + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lattices:
    """Forward tables of distinct chunks. Each place has arcs, its possible last pieces: cumulative shares, lengths, ids."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.size = np.empty(0, np.int64)
        self.base = np.empty(0, np.int64)
        self.first = np.empty(0, np.int64)
        self.cum = np.empty(0, np.float32)
        self.step = np.empty(0, np.int8)
        self.ids = np.empty(0, np.int32)

    def arcs(self, cp: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(last character, length, log-weight, id) of all pieces in the chunks; room: characters from here to the chunk's end."""
        found, live, h = [], np.arange(len(cp)), np.zeros(len(cp), np.uint64)
        alone = np.ones(len(cp), bool)
        for k, (keys, own, weight, slots) in enumerate(self.pieces.tables):
            if k:
                inside = room[live] > k
                live, h = live[inside], h[inside]
            if not len(live):
                break
            h = roll(h, cp[live + k])
            maybe = np.flatnonzero(slots[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)])
            if not len(maybe):
                continue
            at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == h[maybe])
            found.append((live[maybe[hit]] + k, np.full(len(hit), k + 1), weight[at[hit]], own[at[hit]].astype(np.int64)))
            if not k:
                alone[live[maybe[hit]]] = False
        odd = np.flatnonzero(alone)
        found.append((odd, np.ones(len(odd), np.int64), np.full(len(odd), BYTES_WEIGHT), -1 - cp[odd].astype(np.int64)))
        return tuple(map(np.concatenate, zip(*found)))

    def add(self, chunks: list[str]) -> None:
        """Forward filtering of new chunks, all at once, place by place."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        base = np.cumsum(size) - size
        cp = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        place = np.arange(len(cp)) - np.repeat(base, size)  # from 0 in its chunk
        end, step, weight, ids = self.arcs(cp, np.repeat(size, size) - place)
        order = np.lexsort((step, end, place[end]))
        end, step, weight, ids = end[order], step[order], weight[order], ids[order]
        level = place[end]
        cuts = np.searchsorted(level, np.arange(int(size.max()) + 1))
        total, share, first = np.zeros(len(cp)), np.empty(len(end), np.float32), np.empty(len(cp), np.int64)
        for p in range(len(cuts) - 1):
            part = slice(cuts[p], cuts[p + 1])
            here = end[part]
            starts = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
            seg = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(here))))
            m = weight[part] + np.where(step[part] == p + 1, 0.0, total[here - step[part]])
            top = np.maximum.reduceat(m, starts)
            c = np.cumsum(np.exp(m - top[seg]))
            before = np.concatenate(([0.0], c))[starts]
            whole = np.append(before[1:], c[-1]) - before
            share[part] = (c - before[seg]) / whole[seg]
            total[here[starts]] = top + np.log(whole)
            first[here[starts]] = starts + cuts[p]
        last = np.append(end[1:] != end[:-1], True)
        share[last] = 1.0
        places, arcs = len(self.first), len(self.cum)
        self.at.update(zip(chunks, range(len(self.size), len(self.size) + len(chunks))))
        self.size, self.base = np.concatenate((self.size, size)), np.concatenate((self.base, base + places))
        self.first = np.concatenate((self.first, first + arcs))
        self.cum, self.step, self.ids = np.concatenate((self.cum, share)), np.concatenate((self.step, step.astype(np.int8))), np.concatenate((self.ids, ids.astype(np.int32)))

    def sample(self, keys: list[int], texts: list[str | None]) -> list[np.ndarray | None]:
        """Backward sampling: all chunk occurrences of the batch step at once."""
        split = [self.pieces.chunk.findall(t) if t else [] for t in texts]
        if len(self.first) > TASK_CHARS:
            self.clear()
        fresh = list(set().union(*split).difference(self.at))
        if fresh:
            self.add(fresh)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        n = int(counts.sum())
        if not n:
            return [None if t is None else np.empty(0, np.int32) for t in texts]
        known = self.at
        which = np.array([k for own in split for k in map(known.__getitem__, own)], np.int64)
        row = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = mix(mix(np.array(keys, np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))[row] ^ mix(nth.astype(np.uint64)))
        base, place, live = self.base[which], self.size[which].copy(), np.arange(n)
        draws, took = np.zeros(n, np.int64), []
        while len(live):
            u = (mix(seed[live] + np.uint64(len(took))) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            arc = self.first[base[live] + place[live] - 1]
            on = np.flatnonzero(self.cum[arc] <= u)
            while len(on):
                arc[on] += 1
                on = on[self.cum[arc[on]] <= u[on]]
            took.append((live, self.ids[arc]))
            draws[live] += 1
            place[live] -= self.step[arc]
            live = live[place[live] > 0]
        ends = np.cumsum(draws)
        out = np.empty(int(ends[-1]), np.int64)
        for turn, (own, got) in enumerate(took):  # the last drawn comes first
            out[ends[own] - 1 - turn] = got
        per_row = np.bincount(row, weights=draws, minlength=len(texts)).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), per_row)
        odd = np.flatnonzero(out < 0)
        if len(odd):
            spelled = [chr(-1 - x).encode("utf-8", "surrogatepass") for x in out[odd].tolist()]
            wide = np.ones(len(out), np.int64)
            wide[odd] = list(map(len, spelled))
            flags = np.zeros(len(out), bool)
            flags[odd] = True
            out, owner, flags = np.repeat(out, wide), np.repeat(owner, wide), np.repeat(flags, wide)
            out[flags] = [self.pieces.byte[x] for b in spelled for x in b]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [None if t is None else out[cuts[k] : cuts[k + 1]].astype(np.int32) for k, t in enumerate(texts)]


def encode(docs: DataFrame, path: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """doc_id, ids (array<int>) of every document."""
    path = path or model_path()

    def task():
        lattices = Lattices(Pieces(path, alpha))

        def each(x: dict[str, list]) -> dict:
            return {"doc_id": x["doc_id"], "ids": lattices.sample([k or 0 for k in x["doc_id"]], x["text"])}

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), task, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of encoded rows."""
    path = path or model_path()

    def task():
        pieces = Pieces(path)

        def each(x: dict[str, list]) -> dict:
            return {"doc_id": x["doc_id"], "text": [None if i is None else pieces.decode(i) for i in x["ids"]]}

        return each

    return map_rows(encoded.select("doc_id", "ids"), task, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, lossless: the sample of every row, decoded again."""
    path = path or model_path()

    def task():
        lattices = Lattices(Pieces(path, alpha))

        def each(x: dict[str, list]) -> dict:
            ids = lattices.sample([k or 0 for k in x["doc_id"]], x["text"])
            back = ["" if i is None else lattices.pieces.decode(i.tolist() if len(i) else []) for i in ids]
            return {
                "doc_id": x["doc_id"],
                "n_pieces": [0 if i is None else len(i) for i in ids],
                "ids_crc32": [0 if i is None else zlib.crc32(np.asarray(i, "<u4").tobytes()) for i in ids],
                "decoded_sha256": [hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back],
                "lossless": [b == (t or "") for b, t in zip(back, x["text"])],
            }

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), task, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
