"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has an edge for each piece of the vocabulary that stands somewhere in it. No piece has a word mark after
another character, so the lattice falls apart at word marks: a word's segmentations don't depend on its neighbours. Forward
Viterbi scores are computed for all distinct words of a batch at once. They are the exact heuristic of a backward A* search,
which yields a word's segmentations best first; it runs for the words in which a text's N best segmentations can differ.
Characters without a piece score below every piece and are written as bytes.
"""

from __future__ import annotations

import heapq
import marshal
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rolling import between, mix, prefix

MARK, UNKNOWN, NBEST = "▁", -10.0, 4
#: Characters handled at once, those whose lattice edges are tabled at once; words longer than LONG are searched alone; distinct words, and
#: characters of searched words, that a worker remembers.
CHUNK, TABLED, LONG, REMEMBERED, SEARCHED = 250_000, 1 << 16, 64, 500_000, 500_000
ENCODED = "struct<ids:array<int>,nbest:array<struct<score:double,edits:array<struct<at:int,n:int,ids:array<int>>>>>>"
_ARROW = pa.struct([("ids", pa.list_(pa.int32())), ("nbest", pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))])))])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class Vocabulary:
    """A SentencePiece model's pieces and scores, and a table from hashes of pieces to ids."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.scores, self.bytes, self.raw, self.ids = np.zeros(len(ids)), {}, [], {}
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b" \xe2\x81\x87 " if model.is_unknown(i) else b"")
            else:
                self.scores[i], self.ids[piece] = model.get_score(i), i
                self.raw.append(piece.replace(MARK, " ").encode())
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans words")
        self.unknown_id, self.unknown = model.unk_id(), min(self.scores[i] for i in self.ids.values()) + UNKNOWN
        self.longest = max(map(len, self.ids))
        at = np.array([0, *np.cumsum([len(p) for p in self.ids])])
        self.keys, self.values = between(prefix(_codes("".join(self.ids))), at[:-1], at[1:]), np.array([*self.ids.values()], np.int32)
        order = np.argsort(self.keys)
        self.keys, self.values = self.keys[order], self.values[order]
        # the table's slots hold a place in the sorted keys; pieces whose slot is taken stand in the next free one
        self.bits = 20
        self.slots, self.probes = np.full((1 << self.bits) + 64, len(self.keys), np.int32), 1
        for i, slot in enumerate((self.keys >> np.uint64(64 - self.bits)).tolist()):
            n = 1
            while self.slots[slot + n - 1] < len(self.keys):
                n += 1
            self.slots[slot + n - 1], self.probes = i, max(self.probes, n)
        self.keys, self.values = np.append(self.keys, np.uint64(0)), np.append(self.values, np.int32(-1))
        self.searched: dict[tuple[str, int], bytes] = {}
        self.searched_chars = 0
        self.forget()

    def forget(self) -> None:
        self.known = [np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0), np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)]
        self.known_ids = np.empty(0, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash, -1 for none."""
        at, out = (hashes >> np.uint64(64 - self.bits)).astype(np.int64), np.full(len(hashes), -1, np.int32)
        todo = None
        for n in range(self.probes):
            slot = self.slots[at + n] if todo is None else self.slots[at[todo] + n]
            hit = self.keys[slot] == (hashes if todo is None else hashes[todo])
            if todo is None:
                out[hit], todo = self.values[slot[hit]], np.flatnonzero(~hit & (slot < len(self.keys) - 1))
            else:
                out[todo[hit]], todo = self.values[slot[hit]], todo[~hit & (slot < len(self.keys) - 1)]
            if not len(todo):
                break
        return out

    def as_bytes(self, char: str) -> list[int]:
        found = [self.bytes.get(b) for b in char.encode()]
        return [self.unknown_id] if None in found else found

    def search(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first; those of words of up to LONG characters are remembered, up to SEARCHED characters in all."""
        if len(word) > LONG:
            return self._search(word, n)
        found = self.searched.get((word, n))
        if found is None:
            if self.searched_chars > SEARCHED:
                self.searched, self.searched_chars = {}, 0
            found = self.searched[word, n] = marshal.dumps(self._search(word, n))  # a third of the objects' memory
            self.searched_chars += len(word)
        return marshal.loads(found)

    def _search(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """Forward Viterbi, then A* from the end with its scores as heuristic."""
        best = array("d", [0.0])

        def into(end: int) -> list[tuple[int, float, int]]:
            """The lattice's edges that end there; not kept, as a word may be a whole text."""
            out = [(i, self.scores[k], k) for i in range(max(0, end - self.longest), end) if (k := self.ids.get(word[i:end])) is not None]
            return out if word[end - 1] in self.ids else [*out, (end - 1, self.unknown, -1 - ord(word[end - 1]))]

        for end in range(1, len(word) + 1):
            best.append(max(best[i] + s for i, s, _ in into(end)))
        # paths share their ends as linked cells; of equal ones the latest found goes on first
        agenda, found, pushed = [(-best[-1], 0, len(word), 0.0, None)], [], 0
        while agenda and len(found) < n:
            _, _, at, score, path = heapq.heappop(agenda)
            if not at:
                spelt = []
                while path:
                    k, path = path
                    spelt.append(k)
                found.append((score, spelt))
                continue
            for i, s, k in into(at):
                pushed -= 1
                heapq.heappush(agenda, (-(best[i] + s + score), pushed, i, s + score, (k, path)))
            if len(agenda) > 16 * n:
                # the heuristic is exact: each entry stands for a path of its score, so those after the n best come to nothing
                agenda = heapq.nsmallest(n, agenda)
        return [(float(score), tuple(x for k in path for x in ((k,) if k >= 0 else self.as_bytes(chr(-1 - k))))) for score, path in found]

    def look_up(self, codes: np.ndarray, name: np.ndarray, start: np.ndarray, size: np.ndarray, spell) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: score, loss of the second best, number of ids, where they begin in the last array; new words are searched and remembered."""
        if len(self.known[0]) > REMEMBERED:
            self.forget()
        # besides its hash, a remembered word must have the same length and first characters
        looks = size.astype(np.uint64) | codes[start] << np.uint64(20) | codes[start + np.minimum(1, size - 1)] << np.uint64(42)
        at = np.searchsorted(self.known[0], name)
        near = np.minimum(at, max(0, len(self.known[0]) - 1))
        old = (self.known[0][near] == name) & (self.known[1][near] == looks) if len(self.known[0]) else np.zeros(len(name), bool)
        score, loss, count, begin = np.empty(len(name)), np.empty(len(name)), np.empty(len(name), np.int64), np.empty(len(name), np.int64)
        for mine, known in zip((score, loss, count, begin), self.known[2:], strict=True):
            mine[old] = known[near[old]]
        short, long, parts = np.flatnonzero(~old & (size <= LONG)), np.flatnonzero(~old & (size > LONG)), [self.known_ids]
        for some in np.split(short, np.flatnonzero(np.diff(np.cumsum(size[short]) // TABLED)) + 1) if len(short) else ():
            score[some], loss[some], count[some], ids = self.words(codes, start[some], size[some])
            parts.append(ids)
        for w in long.tolist():
            found = self.search(spell(w), 2)
            score[w], loss[w], count[w] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf, len(found[0][1])
            parts.append(np.array(found[0][1], np.int32))
        new, flat = np.r_[short, long], np.concatenate(parts)
        begin[new] = len(self.known_ids) + np.cumsum(count[new]) - count[new]
        # long words are not remembered: how much is kept stays bounded
        keep = short[(self.known[0][near[short]] != name[short])] if len(self.known[0]) else short
        keep = keep[np.argsort(name[keep])]
        where = np.searchsorted(self.known[0], name[keep])
        for i, mine in enumerate((name, looks, score, loss, count, begin)):
            self.known[i] = np.insert(self.known[i], where, mine[keep])
        self.known_ids = flat[: len(self.known_ids) + int(count[short].sum())]
        return score, loss, count, begin, flat

    def words(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words of up to LONG characters: score, loss of the second best, number of ids, and all ids, concatenated."""
        ends = np.cumsum(size)
        first, total = ends - size, int(ends[-1])
        codes = codes[np.arange(total) - np.repeat(first - start, size)]
        sums, left = prefix(codes), np.repeat(ends, size) - np.arange(total)
        piece = np.full((min(self.longest, int(size.max())), total), -1, np.int32)
        for n in range(1, len(piece) + 1):
            at = np.flatnonzero(left >= n) if n > 1 else np.arange(total)
            piece[n - 1, at] = self.find(between(sums, at, at + n))
        lone = piece[0] < 0
        cost = np.where(piece >= 0, self.scores[np.maximum(piece, 0)], -np.inf)
        cost[0, lone] = self.unknown
        order = np.argsort(-size, kind="stable")
        width = int(size.max()) + 1
        best, second, back = np.full((width, len(size)), -np.inf), np.full((width, len(size)), -np.inf), np.zeros((width, len(size)), np.int8)
        best[0], from_, sizes = 0, first[order], -size[order]
        for end in range(1, width):
            live = int(np.searchsorted(sizes, -end, "right"))
            b, s, k = best[end, :live], second[end, :live], back[end, :live]
            for n in range(1, min(end, len(piece)) + 1):
                add = cost[n - 1, from_[:live] + end - n]
                hit = np.flatnonzero(add > -np.inf)
                if len(hit) > live // 2:
                    one, two = best[end - n, :live] + add, second[end - n, :live] + add
                    np.maximum(s, two, out=s)
                    np.maximum(s, np.minimum(b, one), out=s)
                    np.copyto(k, n, where=one > b)
                    np.maximum(b, one, out=b)
                elif len(hit):
                    add = add[hit]
                    one, two, was = best[end - n, hit] + add, second[end - n, hit] + add, b[hit]
                    s[hit] = np.maximum(np.maximum(s[hit], two), np.minimum(was, one))
                    k[hit[one > was]] = n
                    b[hit] = np.maximum(was, one)
        rows = np.arange(len(size))
        score, loss = np.empty(len(size)), np.empty(len(size))
        score[order] = best[size[order], rows]
        loss[order] = best[size[order], rows] - second[size[order], rows]
        chosen, at, live = np.full(total, -2, np.int32), size[order].copy(), rows
        while len(live):
            n = back[at[live], live].astype(np.int64)
            at[live] -= n
            where = from_[live] + at[live]
            chosen[where] = piece[n - 1, where]
            live = live[at[live] > 0]
        where = np.flatnonzero(chosen > -2)
        ids, count = chosen[where], np.ones(len(where), np.int64)
        if (ids < 0).any():
            spelt = {c: self.as_bytes(chr(c)) for c in np.unique(codes[where[ids < 0]]).tolist()}
            out = [[i] if i >= 0 else spelt[c] for i, c in zip(ids.tolist(), codes[where].tolist(), strict=True)]
            count = np.fromiter(map(len, out), np.int64, len(out))
            ids = np.fromiter((x for xs in out for x in xs), np.int32, int(count.sum()))
        return score, loss, np.add.reduceat(count, np.searchsorted(where, first)), ids


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each part, concatenated."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _combine(ways: list[tuple[int, list]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n combinations of one way for each word with the least loss in all; ways: place, segmentations best first."""
    losses = [[w[0][0] - x[0] for x in w] for _, w in ways]
    start = (0,) * len(ways)
    heap, seen, out = [(0.0, start)], {start}, []
    while heap and len(out) < n:
        loss, pick = heapq.heappop(heap)
        out.append((loss, pick))
        for i in range(len(ways)):
            if pick[i] + 1 < len(losses[i]) and (more := (*pick[:i], pick[i] + 1, *pick[i + 1 :])) not in seen:
                seen.add(more)
                heapq.heappush(heap, (sum(x[j] for x, j in zip(losses, more, strict=True)), more))
    return out


def encode_batch(v: Vocabulary, texts: list[str], nbest: int = NBEST) -> list[tuple[np.ndarray, list[dict]]]:
    """Ids of the best segmentation and the ``nbest`` best of each nonempty text."""
    marked = [(MARK + t).replace(" ", MARK) for t in texts]
    codes = _codes("".join(marked))
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    is_mark = codes == ord(MARK)
    opens = is_mark & ~np.r_[False, is_mark[:-1]]
    opens[np.cumsum(size) - size] = True
    start = np.flatnonzero(opens)
    length = np.diff(np.r_[start, len(codes)])
    name = between(prefix(codes), start, start + length)
    _, one, which = np.unique(name, return_index=True, return_inverse=True)
    same = codes == codes[_gather(start[one][which], length)]
    if not same.all() or (length != length[one][which]).any():  # two words with one hash
        spelt = [v_.tobytes() for v_ in np.split(codes, start[1:])]
        places = {}
        which = np.array([places.setdefault(w, len(places)) for w in spelt])
        one = np.unique(which, return_index=True)[1]
    spell = lambda w: codes[start[one[w]] : start[one[w]] + length[one[w]]].astype(np.uint32).tobytes().decode("utf-32-le")
    score, loss, count, begin, flat = v.look_up(codes, name[one], start[one], length[one], spell)
    n_ids = count[which]
    all_ids = flat[_gather(begin[which], n_ids)]
    edges, id_ends = np.searchsorted(start, np.r_[np.cumsum(size) - size, len(codes)]), np.r_[0, np.cumsum(n_ids)]
    totals, losses, out = np.add.reduceat(score[which], edges[:-1]), loss[which], []
    for a, b, total in zip(edges[:-1].tolist(), edges[1:].tolist(), totals.tolist(), strict=True):
        own = losses[a:b]
        near = np.sort(np.argpartition(own, nbest - 2)[: nbest - 1]) if 1 < nbest <= len(own) else np.arange(len(own)) if nbest > 1 else []
        ways = [(a + int(i), v.search(spell(which[a + i]), nbest)) for i in near if own[i] < np.inf]
        found = []
        for lost, pick in _combine(ways, nbest):
            edits = [{"at": int(id_ends[w] - id_ends[a]), "n": int(n_ids[w]), "ids": way[k][1]} for k, (w, way) in zip(pick, ways, strict=True) if k]
            found.append({"score": total - lost, "edits": edits})
        out.append((all_ids[id_ends[a] : id_ends[b]], found))
    return out


def _encoded(v: Vocabulary, texts: pa.Array, nbest: int) -> Iterator[tuple[list[str | None], pa.StructArray]]:
    """Texts in chunks, each with its encoding, so that no more than a chunk's is held at once."""
    empty = (np.empty(0, np.int32), [{"score": 0.0, "edits": []}])
    at = 0
    while at < len(texts) or not at:
        rows, size = [], 0
        while at < len(texts) and size < CHUNK:
            rows.append(texts[at].as_py())
            size, at = size + len(rows[-1] or ""), at + 1
        done = iter(encode_batch(v, [t for t in rows if t], nbest)) if any(rows) else iter(())
        got = [next(done) if t else None if t is None else empty for t in rows]
        offsets = np.r_[0, np.cumsum([len(x[0]) if x else 0 for x in got])].astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x[0] for x in got if x] or [empty[0]])))
        others = pa.array([x and x[1] for x in got], _ARROW.field("nbest").type)
        yield rows, pa.StructArray.from_arrays([ids, others], fields=list(_ARROW), mask=pa.array([x is None for x in got], pa.bool_()))
        at = at or 1


def _decoded(v: Vocabulary, lists: pa.Array) -> list[str | None]:
    raw = v.raw.__getitem__
    joined = (b"".join(map(raw, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else None for x in lists)
    return [None if x is None else x[x[:1] == b" " :].decode("utf-8", "replace") for x in joined]


@lru_cache(1)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(text: Column, model: str, nbest: int = NBEST) -> Column:
    """struct<ids, nbest> of a text, ``model`` being a SentencePiece model file that every machine has.

    ``ids``: the best segmentation; ``nbest``: the best ones by falling score, each as edits of ``ids``: from ``at``, ``n`` ids give way to
    others (see ``segmentation``). Fewer than ``nbest`` come back if a text has no more. Null stays null; an empty text has no ids and
    one segmentation of score 0. Ties come in an order that the text alone decides. Texts are whole, however long.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([x for _, x in _encoded(_vocabulary(model), texts, nbest)])

    return F.arrow_udf(run, ENCODED)(text)


def decode(ids: Column, model: str) -> Column:
    """The text of an array of ids; null for null. Bytes that aren't UTF-8 become U+FFFD, ids outside the vocabulary fail."""

    def run(lists: pa.Array) -> pa.Array:
        return pa.array(_decoded(_vocabulary(model), lists), pa.string())

    return F.arrow_udf(run, "string")(ids)


def encode_documents(docs: DataFrame, model: str, nbest: int = NBEST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` over a table: per row ``doc_id``, ``ids``, ``nbest`` and ``round_trip``, whether ``decode`` gives the text again.

    Rows leave a task a chunk at a time, so long texts don't add up in memory. ``round_trip`` is false for texts that hold the word mark
    itself and null for null texts. Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(model)
        for batch in batches:
            at = 0
            for rows, found in _encoded(v, batch.column(1), nbest):
                ids, others = found.field(0), found.field(1)
                back = [None if t is None else t == x for t, x in zip(rows, _decoded(v, ids), strict=True)]
                missing = found.is_null()
                if any(t is None for t in rows):
                    ids, others = pc.if_else(missing, None, ids), pc.if_else(missing, None, others)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), ids, others, pa.array(back, pa.bool_())], names=["doc_id", "ids", "nbest", "round_trip"])
                at += len(rows)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    inner = ENCODED.removeprefix("struct<").removesuffix(">").split(",", 1)
    return rows.mapInArrow(run, ", ".join(["doc_id long", *[x.replace(":", " ", 1) for x in inner], "round_trip boolean"]))


def segmentation(ids: Column, nbest: Column, k: int) -> Column:
    """The ids of the k-th best segmentation, counted from 0; null if there are fewer."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    rest = lambda at, n: F.slice(ids, at + 1, n)
    step = lambda done, e: F.struct((e["at"] + e["n"]).alias("at"), F.concat(done["out"], rest(done["at"], e["at"] - done["at"]), e["ids"]).alias("out"))
    return F.when(F.size(nbest) > k, F.aggregate(F.get(nbest, F.lit(k))["edits"], start, step, lambda done: F.concat(done["out"], rest(done["at"], F.size(ids)))))
