"""N-gram Jaccard join: vertical partitions of the global n-gram order.

The global order of shingles puts rare ones first: those of a range of the hash space that
few sets hold, then the frequent ones of that range by their frequency, then the rest.
A shingle is renamed by its place in the order and hash bits, so that sorting names sorts
by the order and a fragment is a range of names. Three exact steps:

1. The range (RANGE of the hash space) is cut into fragments. Each counts, for each distinct
   shingle set, how many of its shingles some other set of a compatible size also has;
   the partial counts are summed. Two sets that link differ in so few shingles that, of
   the range's shingles, a stated number must be shared: a set with fewer cannot have a
   partner and leaves here, with most of the corpus. Only four bytes a shingle of the
   range are shuffled.
2. Of the rest, candidate pairs share a shingle of their prefixes under the global order.
   Sets that are already connected by verified links need no further pair, so a large
   group of near copies costs a few links a member, and only pairs across components
   are listed. Each set has a parity sketch: the bits in which two sketches differ are a
   lower bound of the shingles in which the sets differ, so a pair whose sketches differ
   too much cannot link and is not listed. Where lists of many members remain that are not
   connected, the frequencies of all shingles of these members are counted, and the members
   are listed again under an order that puts those last: texts that share a frequent passage, but
   not enough of it, then share no list. Lists that are long even so are dealt in blocks.
3. The order is cut into FRAGMENTS fragments, or more where a cell of similar sets is
   large. A pair's overlap is counted in each fragment separately, the partial overlaps
   are summed per pair and compared as integers.

Copies share a set and are one class throughout. No step holds all pairs of a group,
nor rows of all documents, in one task. Joins with tables of a few numbers a row broadcast
them up to BROADCAST_ROWS rows and shuffle both sides beyond.

Results for edge cases: a null text, or one without words, has n_shingles 0 and is alone
in its component; a null doc_id takes no part (n_shingles and component_id null);
repeated rows are each returned; a repeated doc_id with different texts counts as
different texts; a very long text is hashed by itself and counted like any other; an empty
table gives no rows; other columns, whatever their names, are not read.
A class is named by a 64-bit hash of its set: at 10**9 distinct sets two of them share a
name with probability 0.03.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.components import connected_components
from graphloom.llm.shingles import WORDS, mix, shingle_sets
from graphloom.llm.staging import even_keys, few, lean, partitions, prepare, scratch, stage, text_bytes, tidy

PERCENT = 80
CHUNK_BYTES = 1 << 19  # of text hashed at once
PACK_SHINGLES = 1 << 19  # of the range packed into one row a fragment
RANGE = 0.4  # of the hash space, in which shared shingles are counted first; it affects cost, not results
SIZE_STEP = 1.06  # of the codes of set sizes
SHORT = (1 << 40) - 1  # bits of a class by which its shared shingles are summed; one in common only lets more sets stay
FRAGMENT_SHINGLES = 2_000_000  # of one fragment, in a worker's memory
FREQUENT = 8  # sets that hold a shingle, from which its order is told
ORDERED = 1 << 20  # frequent shingles that the order knows: 16 MB at most; it affects cost, not results
PLACES = 1 << 16  # of the global order; the rare shingles of the range take the first, the frequent ones the next
RARE_PLACES, KNOWN_PLACES = int(0.35 * PLACES), int(0.1 * PLACES)
FRAGMENTS = 4  # of the global order, at least, in which overlaps are counted
CELL_SHINGLES = 200_000  # of one cell's fragment
CELL_PAIRS = 128  # of one cell before it is dealt out
LIST_ROWS = 512  # of one posting list before it is dealt out in blocks
PERMUTATIONS = 8
SKETCH_BITS = 1024  # of a set's parity sketch; it affects cost, not results
STEPS = 8  # next members that each meets, before all pairs across components are listed
LOW32 = np.uint64(0xFFFFFFFF)
LIMIT = np.uint64(int(RANGE * (1 << 24)))  # of the first 24 bits of a hash in the range


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest overlap that any partner of a set of n can have."""
    return -(-percent * n // 100)


def in_range(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)) < LIMIT


def fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment of a hash in the range."""
    return (h >> np.uint64(40)) * np.uint64(fragments) // LIMIT


def tag_of(h: np.ndarray, fragments: int) -> np.ndarray:
    """Name of a shingle of the range in the counts of its fragment."""
    return ((fragment_of(h, fragments) << np.uint64(32)) | (h & LOW32)).astype(np.int64)


def ordered_names(h: np.ndarray, fragments: int, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Shingles named by their place in the global order: 16 bits of place, 48 of the hash.

    known, place: sorted tags of the frequent shingles that the order knows, and their places.
    """
    top = h >> np.uint64(40)
    inside = top < LIMIT
    rest = np.uint64((1 << 24)) - LIMIT
    first = np.uint64(RARE_PLACES + KNOWN_PLACES)
    at = np.where(inside, top * np.uint64(RARE_PLACES) // LIMIT, first + (np.maximum(top, LIMIT) - LIMIT) * (np.uint64(PLACES) - first) // rest)
    if len(known):
        own = np.flatnonzero(inside)
        tag = tag_of(h[own], fragments)
        i = np.minimum(np.searchsorted(known, tag), len(known) - 1)
        hit = known[i] == tag
        at[own[hit]] = place[i[hit]]
    return (at << np.uint64(48)) | (h & np.uint64((1 << 48) - 1))


def cut_of(names: np.ndarray, cuts: int) -> np.ndarray:
    """Fragment of the global order, cut into so many, that each name lies in."""
    return (names >> np.uint64(48)) * np.uint64(cuts) // np.uint64(PLACES)


def text_chunks(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """ids and encoded texts, about CHUNK_BYTES at a time; a longer text comes alone."""
    ids, texts, size = [], [], 0
    for part in parts:
        for i, t in zip(part["doc_id"].to_numpy(), part["text"], strict=True):
            b = t.encode("utf-8", "surrogatepass") if t else b""
            ids.append(i)
            texts.append(b)
            size += len(b) + 1
            if size >= CHUNK_BYTES:
                yield np.array(ids, np.int64), texts
                ids, texts, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


def classes_of(h: np.ndarray, who: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and class of each set; equal sets have equal classes."""
    n = np.bincount(who, minlength=docs)
    edge = np.concatenate(([0], np.cumsum(n)))
    total = lambda v: (lambda s: s[edge[1:]] - s[edge[:-1]])(np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64))))
    a, b = total(mix(h ^ np.uint64(0x5851F42D4C957F2D))), total(mix(h + np.uint64(0x14057B7EF767814F)))
    return n, mix(a ^ mix(b + n.astype(np.uint64))).view(np.int64)


def size_code(n: np.ndarray) -> np.ndarray:
    """A byte for a size, in steps of SIZE_STEP; codes of compatible sizes differ by code_reach at most."""
    return np.minimum(np.log(n) / np.log(SIZE_STEP), 255).astype(np.uint8)


def code_reach(percent: int) -> int:
    return int(np.ceil(np.log(100 / percent) / np.log(SIZE_STEP))) + 1


def heads_of(cls: np.ndarray, n: np.ndarray, k: np.ndarray) -> bytes:
    """Seven bytes a set and fragment: 40 bits of its class, a code of its size, up to 255 postings; a set with more has several."""
    times = -(-k // 255)
    head = np.empty((int(times.sum()), 7), np.uint8)
    head[:, :5] = np.repeat(cls.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5], times, axis=0)
    head[:, 5] = np.repeat(size_code(n), times)
    head[:, 6] = 255
    head[np.cumsum(times) - 1, 6] = k - 255 * (times - 1)
    return head.tobytes()


def heads_from(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 40 bits, size codes and postings of packed heads."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, 7)
    cls = np.zeros((len(raw), 8), np.uint8)
    cls[:, :5] = raw[:, :5]
    return cls.view("<i8")[:, 0], raw[:, 5].astype(np.int64), raw[:, 6].astype(np.int64)


LIGHT = [("id", "<i8"), ("cls", "<i8"), ("n", "<i4"), ("m", "<i4")]  # a document: class, size, shingles in the range
PACKED = "key int, kind int, frag int, head binary, body binary"


def pack(words: int, fragments: int, keys: list[int]):
    """Rows of packed postings by fragment, and of the documents themselves."""

    def flush(held: list[tuple], turn: int) -> pd.DataFrame:
        light = np.concatenate([x for x, _, _ in held])
        first = np.zeros(len(light), bool)
        first[np.unique(light["cls"], return_index=True)[1]] = True
        base = np.cumsum([0, *(len(x) for x, _, _ in held[:-1])])
        who = np.concatenate([w + a for (_, _, w), a in zip(held, base, strict=True)])
        h = np.concatenate([x for _, x, _ in held])[first[who]]
        who = who[first[who]]
        frag = fragment_of(h, fragments).astype(np.uint32)
        order = np.argsort(frag, kind="stable")
        who, frag, low = who[order], frag[order], (h[order] & LOW32).astype("<u4")
        rows = [(keys[turn % len(keys)], 0, 0, light.tobytes(), b"")]
        at = np.searchsorted(frag, np.arange(fragments + 1))
        for f in np.flatnonzero(np.diff(at)):
            a, b = at[f], at[f + 1]
            own = who[a:b]
            cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            rows.append((keys[f], 1, int(f), heads_of(light["cls"][own[cut]], light["n"][own[cut]], np.diff(np.append(cut, b - a))), low[a:b].tobytes()))
        return pd.DataFrame(rows, columns=["key", "kind", "frag", "head", "body"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, turn = [], 0, 0
        for ids, texts in text_chunks(parts):
            h, who = shingle_sets(texts, words)
            n, cls = classes_of(h, who, len(texts))
            inside = in_range(h)
            light = np.zeros(len(ids), LIGHT)
            light["id"], light["cls"], light["n"], light["m"] = ids, cls, n, np.bincount(who[inside], minlength=len(ids))
            held.append((light, h[inside], who[inside]))
            turn = turn or int(ids[0])
            size += len(held[-1][1])
            if size >= PACK_SHINGLES:
                yield flush(held, turn)
                held, size, turn = [], 0, turn + 1
        if held:
            yield flush(held, turn)

    return run


COUNTED = "kind int, a long, b long, c long, d long"


def count_shared(percent: int):
    """For each fragment: shared shingles of each class, and frequent shingles. Documents pass through."""

    def one(heads: list[bytes], bodies: list[bytes], f: int) -> pd.DataFrame:
        given, code, k = heads_from(b"".join(heads))
        h = np.frombuffer(b"".join(bodies), "<u4").astype(np.uint64)
        cls, first, back = np.unique(given, return_index=True, return_inverse=True)
        size = code[first]
        rank = np.argsort(np.lexsort((cls, size)))  # by size, so that partners lie beside each other
        key = np.unique((h << np.uint64(32)) | np.repeat(rank[back], k).astype(np.uint64))
        by_rank = np.argsort(rank)
        n, hh = size[by_rank][(key & LOW32).astype(np.int64)], key >> np.uint64(32)
        near = (hh[1:] == hh[:-1]) & (n[1:] - n[:-1] <= code_reach(percent))
        shared = np.zeros(len(key), bool)
        shared[1:] |= near
        shared[:-1] |= near
        counts = np.bincount((key[shared] & LOW32).astype(np.int64), minlength=len(cls))
        has = np.flatnonzero(counts)
        cut = np.flatnonzero(np.concatenate(([True], hh[1:] != hh[:-1])))
        df = np.diff(np.append(cut, len(hh)))
        often = df >= FREQUENT
        words = (np.uint64(f) << np.uint64(32)) | hh[cut[often]]
        return pd.concat(
            [
                pd.DataFrame({"kind": 1, "a": cls[by_rank][has], "b": counts[has], "c": 0, "d": 0}),
                pd.DataFrame({"kind": 2, "a": words.astype(np.int64), "b": df[often], "c": 0, "d": 0}),
            ]
        )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, bodies = defaultdict(list), defaultdict(list)
        for part in parts:
            for kind, f, head, body in zip(part["kind"], part["frag"], part["head"], part["body"], strict=True):
                if kind:
                    heads[f].append(head)
                    bodies[f].append(body)
                else:
                    light = np.frombuffer(head, LIGHT)
                    yield pd.DataFrame({"kind": 0, "a": light["id"], "b": light["cls"], "c": light["n"].astype(np.int64), "d": light["m"].astype(np.int64)})
        for f in list(heads):
            yield one(heads.pop(f), bodies.pop(f), f)

    return run


SETS = "cls long, n int, shingles binary, prefix binary, mins binary, sketch binary"


def sketch_of(s: np.ndarray) -> bytes:
    """For each bit, the parity of the shingles that fall on it."""
    return np.packbits(np.bincount((s % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def make_sets(words: int, percent: int, fragments: int, frequent):
    """Whole sets of surviving texts with prefix and minima, once a class and task. frequent: broadcast arrays (sorted tags, places)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, place = frequent.value
        seen: set[int] = set()
        for _, texts in text_chunks(parts):
            h, who = shingle_sets(texts, words)
            n, cls = classes_of(h, who, len(texts))
            names = ordered_names(h, fragments, known, place)
            edge = np.concatenate(([0], np.cumsum(n)))
            rows = []
            for i in range(len(texts)):
                s = np.sort(names[edge[i] : edge[i + 1]])
                if not len(s) or int(cls[i]) in seen:
                    continue
                seen.add(int(cls[i]))
                prefix = s[: len(s) - int(least_overlap(len(s), percent)) + 1]
                mins = np.array([mix(s ^ np.uint64(k * 0x9E3779B9 + 1)).min() for k in range(PERMUTATIONS)], np.uint64)
                rows.append((int(cls[i]), len(s), s.astype("<u8").tobytes(), prefix.astype("<u8").tobytes(), mins.astype("<u8").tobytes(), sketch_of(s)))
                if len(rows) == 500:
                    yield pd.DataFrame(rows, columns=["cls", "n", "shingles", "prefix", "mins", "sketch"])
                    rows = []
            yield pd.DataFrame(rows, columns=["cls", "n", "shingles", "prefix", "mins", "sketch"])

    return run


def explode_longs(column: str):
    """(cls, n, place, value) of the 64-bit numbers packed in a column."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            arrays = [np.frombuffer(b, "<i8") for b in part[column]]
            k = np.fromiter(map(len, arrays), np.int64, len(arrays))
            yield pd.DataFrame({"cls": np.repeat(part["cls"].to_numpy(), k), "n": np.repeat(part["n"].to_numpy(), k), "place": np.concatenate([np.arange(x) for x in k]).astype(np.int32), "value": np.concatenate(arrays)})

    return run


def leader_pairs(minima: DataFrame) -> DataFrame:
    """a, b: each class with a few leaders of each of its buckets of equal minima.

    The leaders are minima under different orders, combined on the map side, so a hot
    bucket is not gathered.
    """
    # the set that shares most minima with others is likely the origin of their edits
    counts = stage(minima.groupBy("place", "value").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
    busy = minima.join(counts, ["place", "value"])
    score = stage(busy.groupBy("cls").agg(F.sum("m").alias("score")), "scores")
    busy = stage(busy.join(score, "cls").select("place", "value", "cls", "n", "score"), "busy")
    least = lambda key: F.min(F.struct(key.alias("r"), F.col("cls").alias("c")))
    lead = stage(busy.groupBy("place", "value").agg(F.array(least(-F.col("score")), least(F.col("n").cast("bigint")), least(F.xxhash64("cls"))).alias("lead")), "leaders")
    pairs = busy.join(lead, ["place", "value"])
    return pairs.select(F.col("cls").alias("a"), F.explode(F.array_distinct("lead.c")).alias("b")).filter("a <> b").distinct()


def reaches(na, ia, nb, ib, percent: int) -> np.ndarray:
    """Whether sets whose first common shingle has these places in their orders can still overlap enough."""
    return np.minimum(na - ia, nb - ib) * (100 + percent) >= percent * (na + nb)


def sketches(column: pd.Series) -> np.ndarray:
    """Packed sketches as rows of 64-bit words."""
    return np.frombuffer(b"".join(column), "<u8").reshape(len(column), SKETCH_BITS // 64)


def may_link(na, x, nb, y, percent: int) -> np.ndarray:
    """Whether sets of these sizes and sketches can overlap enough: they differ in no fewer shingles than bits."""
    differ = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return (na + nb - differ) * (100 + percent) >= 2 * percent * (na + nb)


PAIRS = "a long, b long, na long, nb long, ca long, cb long, cell long"


def whole_lists(parts: Iterator[pd.DataFrame], rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Frames of whole posting lists, of a partition sorted by value and block."""
    held: list[pd.DataFrame] = []
    size = 0
    for part in parts:
        if not len(part):
            continue
        held.append(part)
        size += len(part)
        if size < rows:
            continue
        df = pd.concat(held)
        v, block = df["value"].to_numpy(), df["block"].to_numpy()
        last = np.flatnonzero((v != v[-1]) | (block != block[-1]))
        if len(last):
            yield df[: last[-1] + 1]
            df = df[last[-1] + 1 :]
        held, size = [df], len(df)
    if held:
        yield pd.concat(held)


class Lists:
    """Posting lists in the order that arrange(list, value, n, cls) gives, and the pairs picked from them."""

    def __init__(self, df: pd.DataFrame, percent: int, arrange) -> None:
        value, block, n, cls = (df[x].to_numpy(np.int64) for x in ("value", "block", "n", "cls"))
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (block[1:] != block[:-1])))
        of = np.cumsum(new)
        order = arrange(of, value, n, cls)
        self.of, self.side = of[order], df["side"].to_numpy()[order]
        self.n, self.c, self.k, self.at, self.cell = (df[x].to_numpy(np.int64)[order] for x in ("n", "component", "cls", "place", "cell"))
        self.bits, self.percent = sketches(df["sketch"])[order], percent

    def worth(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) lie in different components and can still overlap enough, of different sides."""
        n, at, side = self.n, self.at, self.side
        ok = np.flatnonzero((self.c[i] != self.c[j]) & ((side[i] < 0) | (side[i] != side[j])) & reaches(n[i], at[i], n[j], at[j], self.percent))
        i, j = i[ok], j[ok]
        return ok[may_link(n[i], self.bits[i], n[j], self.bits[j], self.percent)]

    def rows(self, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        swap = self.k[i] > self.k[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        made = pd.DataFrame({"a": self.k[i], "b": self.k[j], "na": self.n[i], "nb": self.n[j], "ca": self.c[i], "cb": self.c[j], "cell": self.cell[i]})
        return made.drop_duplicates(["a", "b"])


def next_pairs(percent: int):
    """For each member of a posting list, the next few in an order of the list's own, if in another component."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in whole_lists(parts):
            lists = Lists(df, percent, lambda of, v, n, k: np.lexsort((mix((k ^ v).view(np.uint64)), of)))
            for step in range(1, STEPS + 1):
                i = np.flatnonzero(lists.of[step:] == lists.of[:-step])
                ok = lists.worth(i, i + step)
                if len(ok):
                    yield lists.rows(i[ok], i[ok] + step)

    return run


def ends_of(of: np.ndarray, n: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """For members sorted by list and size: where those end that the member can link to as the smaller of two.

    Such a partner has n * 100 / percent shingles at most, and no more than what lies
    behind the member's place still allows.
    """
    most = np.minimum(n * 100 // percent, (n - at) * (100 + percent) // percent - n)
    step = np.int64(n.max(initial=0)) * 2 + 2
    return np.searchsorted(of * step + n, of * step + np.clip(most, -1, step - 1), "right")


def cross_pairs(percent: int):
    """Pairs of a posting list that lie in different components and can still overlap enough."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in whole_lists(parts):
            lists = Lists(df, percent, lambda of, v, n, k: np.lexsort((k, n, of)))
            end = ends_of(lists.of, lists.n, lists.at, percent)
            at, step = np.arange(len(df)), 1
            out: list[pd.DataFrame] = []
            while len(at := at[at + step < end[at]]):  # each with the one that lies step members on
                for part in np.array_split(at, -(-len(at) // 100_000)):
                    ok = lists.worth(part, part + step)
                    if len(ok):
                        out.append(lists.rows(part[ok], part[ok] + step))
                step += 1
                if sum(map(len, out)) > 250_000:
                    yield pd.concat(out).drop_duplicates(["a", "b"])
                    out = []
            if out:
                yield pd.concat(out).drop_duplicates(["a", "b"])

    return run


def sift(percent: int):
    """Pairs with both sketches, without those that cannot link."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            na, nb = part["na"].to_numpy(np.int64), part["nb"].to_numpy(np.int64)
            keep = may_link(na, sketches(part["x"]), nb, sketches(part["y"]), percent) if len(part) else np.zeros(0, bool)
            yield part.loc[keep, ["a", "b", "na", "nb", "ca", "cb", "cell"]]

    return run


SLICED = "cell long, deal int, frag int, cls long, other long, sizes long, ca long, cb long, data binary"


def slice_sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A set's part in each fragment of the order, as its cell cuts it; empty parts are left out."""
    for part in parts:
        rows = []
        for cell, deal, cuts, cls, data in zip(part["cell"], part["deal"], part["cuts"], part["cls"], part["shingles"], strict=True):
            s = np.frombuffer(data, "<u8")
            at = np.searchsorted(cut_of(s, cuts), np.arange(cuts + 1))
            rows += [(cell, deal, f, cls, 0, 0, 0, 0, s[at[f] : at[f + 1]].tobytes()) for f in range(cuts) if at[f] < at[f + 1]]
        yield pd.DataFrame(rows, columns=["cell", "deal", "frag", "cls", "other", "sizes", "ca", "cb", "data"])


def count_overlaps(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial overlap of each pair in each cell's fragment; a fragment's sets come before its pairs."""
    now, sets = None, {}
    for part in parts:
        rows = []
        for cell, deal, frag, cls, other, *more, data in part.itertuples(index=False, name=None):
            if now != (cell, deal, frag):
                now, sets = (cell, deal, frag), {}
            if data is not None:
                sets[cls] = np.frombuffer(data, "<u8")
                continue
            x, y = sets.get(cls), sets.get(other)
            if x is None or y is None:
                continue
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            if overlap := int((y[at] == x).sum()):
                rows.append((cls, other, *more, overlap))
        yield pd.DataFrame(rows, columns=["a", "b", "sizes", "ca", "cb", "overlap"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int, fragments: int = FRAGMENTS) -> DataFrame | None:
    """The components (ca, cb) of the pairs of which 100 * overlap >= percent * union; None without pairs.

    A pair is counted in the cell of its first set, in each fragment of the global order. A
    cell with many pairs is dealt out by a hash of the pair, and one with many shingles is
    cut into more fragments.
    """
    spark = sets.sparkSession
    p = stage(pairs.distinct(), "pairs")
    if p.isEmpty():
        return None
    deals = stage(p.groupBy("cell").agg(F.ceil(F.count("*") / CELL_PAIRS).cast("int").alias("deals")), "deals")
    p = stage(p.join(few(deals), "cell").withColumn("deal", F.pmod(F.xxhash64("a", "b"), F.col("deals")).cast("int")).drop("deals"), "dealt")
    ends = p.select("cell", "deal", F.col("a").alias("cls"), F.col("na").alias("n")).unionByName(p.select("cell", "deal", F.col("b").alias("cls"), F.col("nb").alias("n")))
    need = stage(ends.distinct(), "ends")
    cuts = stage(need.groupBy("cell", "deal").agg(F.greatest(F.lit(fragments), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int").alias("cuts")), "cuts")
    need = stage(need.join(few(cuts), ["cell", "deal"]).drop("n"), "need")
    slices = sets.select("cls", "shingles").join(few(need), "cls").select("cell", "deal", "cuts", "cls", "shingles").mapInPandas(slice_sets, SLICED)
    frag = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("frag")
    sizes = (F.col("na") + F.col("nb")).alias("sizes")
    tasks = p.join(few(cuts), ["cell", "deal"]).select("cell", "deal", frag, F.col("a").alias("cls"), F.col("b").alias("other"), sizes, "ca", "cb", F.lit(None).cast("binary").alias("data"))
    dealt = slices.unionByName(tasks).repartition(partitions(spark), "cell", "deal", "frag").sortWithinPartitions("cell", "deal", "frag", F.col("data").isNull())
    partial = dealt.mapInPandas(count_overlaps, "a long, b long, sizes long, ca long, cb long, overlap long")
    total = partial.groupBy("a", "b", "sizes", "ca", "cb").agg(F.sum("overlap").alias("overlap"))
    linked = total.filter(F.col("overlap") * 100 >= (F.col("sizes") - F.col("overlap")) * percent)
    return stage(linked.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "links")


def known_order(counts: DataFrame, most: int = ORDERED) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tags of the most frequent shingles, at most so many, and their places. counts: staged a (tag), b (sets).

    A threshold on the frequency is found from its histogram, of a few hundred rows, so no
    partition sends more than what is kept.
    """
    level = F.floor(F.log2("b") * 8).cast("int")
    levels = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for at, n in levels:
        total += n
        if total > most:
            break
        least = at
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    top = counts.filter(level >= least).select("a", "b").toPandas().sort_values("a")
    tags, often = top["a"].to_numpy(np.int64), top["b"].to_numpy(np.int64)
    rank = np.argsort(np.lexsort((tags, often)))
    return tags, (RARE_PLACES + rank * KNOWN_PLACES // len(tags)).astype(np.uint64)


def alive_classes(classes: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """cls, rep of the classes that can have a partner.

    A partner lacks at most n - least_overlap(n) shingles of a set, so at least the rest of
    the m in the range are shared. Two different sets have a shingle that is not common, so
    that a small set (of less than 4 at 80 %) links with its equals only, which are its class.
    classes: cls, rep, n, m; shared: short (SHORT of cls), shared.
    """
    classes = classes.filter(F.col("n") * (100 - percent) >= percent)
    lacks = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100))
    return classes.withColumn("short", F.col("cls").bitwiseAND(F.lit(SHORT))).join(shared, "short", "left").filter(F.coalesce("shared", F.lit(0)) >= F.col("m") - lacks).select("cls", "rep")


def mixed_lists(posts: DataFrame, label: DataFrame) -> DataFrame:
    """Rows (value, fam, n, place, cls, m) of posting lists whose m members lie in several components.

    The components of a list are compared by their extremes, combined on the map side, so
    that a hot list is not gathered. Of lists with the same members, only the first in the
    order (fam tells orders apart) is needed: it has the first shingle that any two of them share.
    Members are compared by their number, their extreme components and a hash of all.
    """
    named = posts.join(few(label), "cls")
    members = F.bit_xor(F.xxhash64("cls")).alias("members")
    ends = named.groupBy("value", "fam").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), members)
    unsigned = F.col("value").bitwiseXOR(F.lit(-(1 << 63)))
    first = ends.filter("lo < hi").groupBy("lo", "hi", "m", "members", "fam").agg(F.min(unsigned).alias("value"))
    mixed = stage(first.select(unsigned.alias("value"), "fam", "m"), "mixed")
    return stage(posts.select("value", "fam", "n", "place", "cls").join(few(mixed), ["value", "fam"]), "lists")


def order_again(percent: int, hot):
    """Prefixes of whole sets under an order that puts hot shingles last; hot: broadcast arrays (sorted names, places)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, place = hot.value
        for part in parts:
            out = []
            for cls, n, data in zip(part["cls"], part["n"], part["shingles"], strict=True):
                s = np.frombuffer(data, "<u8")
                at = np.minimum(np.searchsorted(known, s.view(np.int64)), len(known) - 1)
                often = known[at] == s.view(np.int64)
                low = s & np.uint64((1 << 47) - 1)
                again = np.sort(np.where(often, np.uint64(1 << 63) | (place[at] << np.uint64(47)) | low, s >> np.uint64(1)))
                prefix = again[: n - int(least_overlap(int(n), percent)) + 1]
                out.append(pd.DataFrame({"cls": cls, "n": n, "place": np.arange(len(prefix), dtype=np.int32), "value": prefix.view(np.int64)}))
            if out:
                yield pd.concat(out)

    return run


def relisted(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Posting lists (cls, n, place, value), under an order of their own, of the members of long lists; None without any.

    Two members of long lists that link share a shingle of these prefixes too; a member of a
    long list and another set that link share a short list, or are connected already.
    """
    members = lists.filter(F.col("m") > LIST_ROWS)
    if members.isEmpty():
        return None
    members = few(stage(members.select("cls").distinct(), "members"))
    whole = stage(sets.select("cls", "n", "shingles").join(members, "cls", "left_semi"), "whole")
    counts = whole.mapInPandas(explode_longs("shingles"), "cls long, n int, place int, value long").groupBy(F.col("value").alias("a")).agg(F.count("*").alias("b"))
    hot = known_order(stage(counts.filter(F.col("b") > LIST_ROWS), "hot"))
    if not len(hot[0]):
        hot = (np.zeros(1, np.int64), np.zeros(1, np.uint64))
    again = sets.sparkSession.sparkContext.broadcast(hot)
    return stage(whole.mapInPandas(order_again(percent, again), "cls long, n int, place int, value long"), "again")


def dealt_lists(lists: DataFrame, label: DataFrame, extra: DataFrame, whole: bool) -> DataFrame:
    """Lists with component, sketch and cell, dealt by value; long ones in blocks of about two times LIST_ROWS at most.

    With whole, each two members of a list that lie in different components meet in one
    block: members of the list's most frequent component (major) and the others (minor),
    which remain after most are linked, are cut into parts by a hash; there is a block for
    each two minor parts, and for each major part with each minor part. side tells the two
    parts of a block apart; -1 is a block of one part. Otherwise a member is in one block.
    """
    spark = lists.sparkSession
    full = lists.join(few(label), "cls")
    part = lambda n: F.pmod(F.xxhash64("cls"), n)
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / LIST_ROWS)).cast("bigint")
    at = lambda block, side: F.struct(block.cast("bigint").alias("block"), side.cast("int").alias("side"))
    one = F.array(at(part(parts(F.col("m"))), F.lit(-1)))
    if whole:
        sizes = full.filter(F.col("m") > LIST_ROWS).groupBy("value", "m", "component").count()
        major = sizes.groupBy("value", "m").agg(F.max(F.struct("count", "component")).alias("x"))
        major = stage(major.select("value", F.col("x.component").alias("major"), parts(F.col("m") - F.col("x.count")).alias("s"), parts(F.col("x.count")).alias("t")), "majors")
        full = full.join(few(major), "value", "left")
        s, t, own = F.col("s"), F.col("t"), part(F.col("s"))
        minors = F.transform(F.sequence(F.lit(0).cast("bigint"), s - 1), lambda x: at(F.least(own, x) * s + F.greatest(own, x), F.when(x == own, -1).when(own < x, 0).otherwise(1)))
        across = F.transform(F.sequence(F.lit(0).cast("bigint"), t - 1), lambda x: at(s * s + x * s + own, F.lit(1)))
        majors = F.transform(F.sequence(F.lit(0).cast("bigint"), s - 1), lambda x: at(s * s + part(t) * s + x, F.lit(0)))
        one = F.when(F.col("major").isNull(), one).when(F.col("major") == F.col("component"), majors).otherwise(F.concat(minors, across))
    full = full.withColumn("x", F.explode(one)).select("value", "x.block", "x.side", "n", "component", "cls", "place")
    full = full.join(extra, "cls").select("value", "block", "side", "n", "component", "cls", "place", "sketch", "cell")
    return full.repartition(partitions(spark), "value", "block").sortWithinPartitions("value", "block")


def classed_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, cuts: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id, copies, cls, team for every row of docs (doc_id, text); staged.

    team names the component; component_id does not, where a doc_id has different texts.
    cuts: fragments of the global order, at least, in which overlaps are counted.
    """
    spark = docs.sparkSession
    prepare(spark)
    with scratch(spark) as keep:
        return keep(_components(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), words, percent, cuts), "components")


def _linked(sets: DataFrame, percent: int, cuts: int) -> DataFrame:
    """cls, component of the sets that can have a partner; every table here grows with them alone."""
    minima = stage(sets.select("cls", "n", "mins").mapInPandas(explode_longs("mins"), "cls long, n int, place int, value long"), "minima")
    # a cell gathers sets that are likely alike: the smallest leader of their buckets
    lead = stage(minima.groupBy("place", "value").agg(F.min("cls").alias("lead")), "leaders")
    cell = stage(minima.join(lead, ["place", "value"]).groupBy("cls").agg(F.min("lead").alias("cell")), "cells")
    ends = stage(sets.select("cls", F.col("n").cast("bigint").alias("n"), "sketch").join(few(cell), "cls"), "ends")
    label = stage(sets.select("cls", F.col("cls").alias("component")), "labels")

    def relabel(label: DataFrame, links: DataFrame | None) -> DataFrame:
        """Labels after links between components."""
        if links is None or links.isEmpty():
            return label
        found = stage(connected_components(links).select(F.col("id").alias("component"), F.col("component").alias("low")), "found")
        return stage(label.join(few(found), "component", "left").select("cls", F.coalesce("low", "component").alias("component")), "labels")

    led = leader_pairs(minima).join(ends.toDF("a", "na", "x", "cell"), "a").join(ends.drop("cell").toDF("b", "nb", "y"), "b")
    led = led.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    led = led.select("a", "b", "na", "nb", F.col("a").alias("ca"), F.col("b").alias("cb"), "cell", "x", "y").mapInPandas(sift(percent), PAIRS)
    label = relabel(label, verified(led, sets, percent, cuts))

    posts = sets.select("cls", "n", "prefix").mapInPandas(explode_longs("prefix"), "cls long, n int, place int, value long")
    extra = ends.select("cls", "sketch", "cell")
    lists = mixed_lists(posts.withColumn("fam", F.lit(0)), label)
    if (again := relisted(lists, sets, percent)) is not None:
        lists = lists.filter(F.col("m") <= LIST_ROWS).unionByName(mixed_lists(again.withColumn("fam", F.lit(1)), label))
    for pick in (next_pairs, cross_pairs):
        if pick is cross_pairs:  # a list that is not mixed any more never is again
            lists = mixed_lists(lists, label)
        pairs = dealt_lists(lists, label, extra, pick is cross_pairs).mapInPandas(pick(percent), PAIRS)
        label = relabel(label, verified(pairs, sets, percent, cuts))

    return label


def _components(given: DataFrame, words: int, percent: int, cuts: int) -> DataFrame:
    spark = given.sparkSession
    known = given.filter("doc_id is not null")
    fragments = max(partitions(spark), -(-int(text_bytes(known) * RANGE) // (6 * FRAGMENT_SHINGLES)))
    packed = known.mapInPandas(tidy(pack(words, fragments, even_keys(fragments))), PACKED).repartition(fragments, "key")
    counted = stage(packed.mapInPandas(tidy(count_shared(percent)), COUNTED), "shared", "kind")
    light = counted.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), F.col("c").alias("n"), F.col("d").alias("m"))
    classes = stage(light.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("m").alias("m"), F.count("*").alias("copies")), "classes")
    shared = stage(counted.filter("kind = 1").groupBy(F.col("a").alias("short")).agg(F.sum("b").alias("shared")), "sums")
    alive = stage(alive_classes(classes, shared, percent), "alive")

    frequent = spark.sparkContext.broadcast(known_order(counted.filter("kind = 2").select("a", "b")))
    reps = stage(alive.select(F.col("rep").alias("doc_id")).distinct(), "reps")
    made = known.join(few(reps), "doc_id", "left_semi").mapInPandas(tidy(make_sets(words, percent, fragments, frequent)), SETS)
    sets = stage(made.join(few(alive.select("cls")), "cls", "left_semi"), "sets")
    size = alive.count()
    if sets.count() > size:  # a row that is there several times
        sets = stage(sets.dropDuplicates(["cls"]), "sets")
    with lean(size):
        label = _linked(sets, percent, cuts)
    named = label.join(classes, "cls")
    least = stage(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    linked = named.join(least, "component").select("cls", "component_id", "component")
    table = classes.join(linked, "cls", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id"), "copies", F.coalesce("component", "cls").alias("team"))
    out = light.join(stage(table, "classes"), "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("copies")).otherwise(F.lit(1)).alias("copies"),
        "cls",
        "team",
    )
    none = F.lit(None).cast("bigint")
    return out.unionByName(given.filter("doc_id is null").select("doc_id", *[none.alias(x) for x in ("n_shingles", "component_id", "copies", "cls", "team")]))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, cuts: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id, copies for every row of docs (doc_id, text)."""
    return classed_components(docs, words, percent, cuts).select("doc_id", "n_shingles", "component_id", "copies")


def class_column(words: int):
    """The class of a text, as the components have it."""

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            frame = pd.DataFrame({"doc_id": np.zeros(len(part), np.int64), "text": part.to_numpy()})
            got = [classes_of(*shingle_sets(texts, words), len(texts))[1] for _, texts in text_chunks(iter([frame]))]
            yield pd.Series(np.concatenate(got) if got else np.zeros(0, np.int64))

    return of


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the near copies: of each component one row of its smallest doc_id stays.

    Rows with a null doc_id stay. Rows that share a doc_id are decided by their classes:
    of those of one class one stays, if the class is the one that its component keeps;
    different texts under one doc_id do not touch each other. Rows of other doc_ids are
    joined by doc_id alone; up to BROADCAST_ROWS doc_ids to drop, texts are not moved.
    An empty table stays empty. Other columns, whatever their names, pass through.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        got = stage(classed_components(docs).select("doc_id", "component_id", "n_shingles", "cls", "team").filter("doc_id is not null"), "decided")
        twice = keep(got.groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("doc_id").alias("twice")), "twice")
        gone = keep(got.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
        best = got.filter("n_shingles > 0").groupBy("team").agg(F.min(F.struct("doc_id", "cls")).alias("best")).select("best.doc_id", "best.cls")
        stays = best.unionByName(got.filter("n_shingles = 0").select("doc_id", "cls").distinct())
        stays = keep(stays.join(few(twice), F.col("doc_id") == F.col("twice"), "left_semi").toDF("stay_id", "stay_cls"), "stays")
    gone = few(gone)
    if twice.isEmpty():
        return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    twice, stays = few(twice), few(stays)
    single = docs.join(twice, docs["doc_id"] == twice["twice"], "left_anti")
    single = single.join(gone, single["doc_id"] == gone["gone"], "left_anti")
    cls = "cls"
    while cls in map(str.lower, docs.columns):
        cls += "_"
    again = docs.join(twice, docs["doc_id"] == twice["twice"], "left_semi").withColumn(cls, class_column(WORDS)("text"))
    again = again.join(stays, (again["doc_id"] == stays["stay_id"]) & (again[cls] == stays["stay_cls"]), "left_semi")
    return single.unionByName(again.dropDuplicates(["doc_id", cls]).drop(cls))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
h AS (SELECT doc_id, hash(g) AS g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
f AS (SELECT g, count(*) AS df FROM h GROUP BY g HAVING count(*) > 1),
p AS (SELECT h.doc_id, h.g, row_number() OVER (PARTITION BY h.doc_id ORDER BY coalesce(f.df, 1), h.g) AS r, n FROM h JOIN n USING (doc_id) LEFT JOIN f USING (g)),
q AS (SELECT doc_id, g, n FROM p WHERE r <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM q a JOIN q b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
o AS (SELECT a, b, any_value(na) AS na, any_value(nb) AS nb, count(*) AS o FROM c JOIN h x ON x.doc_id = a JOIN h y ON y.doc_id = b AND y.g = x.g GROUP BY a, b),
l AS (SELECT a, b FROM o WHERE 100 * o >= 80 * (na + nb - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, a AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id WHERE r.low < e.b),
m AS (SELECT id, min(low) AS low FROM r GROUP BY id),
k AS (SELECT hash_of, count(*) AS copies FROM (SELECT doc_id, (SELECT count(*) FROM n WHERE n.doc_id = d.doc_id) AS z, hash_of FROM (SELECT doc_id, list(g ORDER BY g) AS hash_of FROM h GROUP BY doc_id) d) GROUP BY hash_of),
j AS (SELECT doc_id, copies FROM (SELECT doc_id, list(g ORDER BY g) AS hash_of FROM h GROUP BY doc_id) JOIN k USING (hash_of))
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.low, d.doc_id) AS component_id, coalesce(j.copies, 1) AS copies
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = d.doc_id LEFT JOIN j ON j.doc_id = d.doc_id
"""
