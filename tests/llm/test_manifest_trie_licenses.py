"""Merkle manifest, prefix trie and license scan against plain Python, and on odd tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from graphloom.llm import op11_prefix_trie as op11
from graphloom.llm import op12_license_scan as op12
from graphloom.llm import op13_merkle_manifest as op13
from graphloom.llm.places import numbered
from graphloom.llm.staging import scratch, stage

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int"


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode())


# --- manifest ---


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """Rows of the manifest by the definition, level by level."""
    say = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda d, t, la, s, n: H(*map(say, (d, s, la, n, t)))

    def tree(leaves):
        """The root, and each leaf's siblings as (left, right) a level."""
        proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
        while len(level) > 1:
            for i, p in enumerate(at):
                run = level[p - p % 3 : p - p % 3 + 3]
                proofs[i].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
            level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
            at = [p // 3 for p in at]
        return level[0], proofs

    by = defaultdict(list)
    for d, t, la, s, n, *_ in rows:
        by[s].append((d is not None, d or 0, leaf_of(d, t, la, s, n), d, t, la, n))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by[s], key=lambda r: r[:3]), *tree([r[2] for r in sorted(by[s], key=lambda r: r[:3])])) for s in sources}
    root, upper = tree([trees[s][1] for s in sources]) if sources else (None, [])
    out = []
    for s, above in zip(sources, upper, strict=True):
        leaves, subroot, proofs = trees[s]
        for (_, _, leaf, d, t, la, n), proof in zip(leaves, proofs, strict=True):
            whole = proof + above
            folded = leaf_of(d, t.replace("\n", ""), la, s, n) if d is not None and t is not None and crc(d) % 2 == 0 else leaf
            for left, right in whole:
                folded = H(left, folded, right)
            out.append((d, leaf, subroot, root, H(*[x for step in whole for x in step]), folded, folded == root))
    return sorted(out, key=repr)


def manifest_of(df):
    got = op13.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in got.collect()), key=repr)


def documents_of(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, "", "line one\nline two", "plain", "ünï\n" * rng.randrange(5)])
        rows.append((rng.choice([None, i]) if i % 17 == 0 else i, text, rng.choice([None, "en"]), rng.choices(["hot", "b", None, "", f"s{i % 11}", "é"], [9, 2, 1, 1, 2, 1])[0], rng.choice([None, i, -1]), "clash", 7))
    return rows + rows[:5]  # repeated rows


@pytest.mark.parametrize(("n", "parts"), [(1, 1), (3, 2), (400, 5)])
def test_manifest_against_brute_force(spark, n, parts):
    rows = documents_of(n, n)
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(parts)
    assert manifest_of(df) == brute_manifest(rows)


def test_manifest_of_more_levels_than_a_band(spark, monkeypatch):
    monkeypatch.setattr(op13, "BAND", 2)
    rows = [(i, f"text\n{i}", "en", "one" if i % 10 else "two", i, "", 0) for i in range(1200)]
    assert manifest_of(spark.createDataFrame(rows, DOCUMENTS).repartition(7)) == brute_manifest(rows)


def test_manifest_edges(spark):
    assert manifest_of(spark.createDataFrame([], DOCUMENTS)) == []
    lone = [(4, "only\n" * 300_000, None, None, None, "", 0)]  # long, and its source null
    assert manifest_of(spark.createDataFrame(lone, DOCUMENTS)) == brute_manifest(lone)
    many = [(i, str(i), "en", f"source {i:03}", 1, "", 0) for i in range(90)]  # every leaf a subroot
    got = manifest_of(spark.createDataFrame(many, DOCUMENTS))
    assert got == brute_manifest(many) and all(r[1] == r[2] for r in got)


def test_partial_parents_wait_for_their_children():
    import pyarrow as pa

    def nodes(places):
        t = pa.table({"source": ["s"] * len(places), "level": [0] * len(places), "place": places, "width": [10] * len(places), "digest": [bytes([p]) * 32 for p in places]})
        return [r for b in op13.accumulate(iter(t.to_batches())) for r in b.to_pylist()]

    made = nodes([5, 3, 9, 4, 0, 2])  # the last run has one child; 1, 6, 7, 8 are elsewhere
    assert sorted((r["level"], r["place"]) for r in made if r["kind"] == op13.PARENT) == [(1, 1), (1, 3), (2, 1)]
    assert sorted((r["level"], r["place"]) for r in made if r["kind"] == op13.CHILD) == [(0, 0), (0, 2), (1, 1), (2, 1)]
    whole = nodes([7, 1, 0, 2, 9, 8, 6, 5, 4, 3])
    assert [r["level"] for r in whole if r["kind"] == op13.TOP] == [3] and not [r for r in whole if r["kind"] == op13.CHILD]


def test_places_follow_the_order_in_hot_and_null_groups(spark):
    rows = [("hot", 500 - i) for i in range(500)] + [(None, i) for i in range(7)] + [("b", None), ("b", 1)]
    with scratch(spark) as keep:
        got = keep(numbered(stage(spark.createDataFrame(rows, "g string, v int").repartition(6), "rows"), ["g"], ["v"], "numbered"), "out").collect()
    assert {(r["g"], r["v"], r["place"], r["width"]) for r in got} == {("hot", i, i - 1, 500) for i in range(1, 501)} | {(None, i, i, 7) for i in range(7)} | {("b", None, 0, 2), ("b", 1, 1, 2)}


# --- trie ---

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, digest string"


def brute_trie(rows, mixed):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = own
    if mixed:
        built = {}
        for c, v in own.items():
            h, donor = crc(c) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
            built[c] = own.get(donor, [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for name in nodes:
        if name:
            children[name[:-1]].append(name)
    leaves, saved = {}, {}
    for name in sorted(nodes, key=len, reverse=True):
        below = children[name]
        leaves[name] = sum(leaves[b] for b in below) if below else 1
        saved[name] = sum(saved[b] for b in below) + (len(nodes[name]) - 1) * (len(name[-1][1]) if name else 0)
    ends = {name: ",".join(map(str, sorted(c for c in of if len(built[c]) == len(name)))) for name, of in nodes.items()}
    return sorted(((min(of), len(n), min(nodes[n[:-1]]) if n else None, len(of), len(children[n]), leaves[n], saved[n], sha256(ends[n].encode()).hexdigest()) for n, of in nodes.items()), key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(df, mixed):
    return sorted((tuple(r[c] for c in TRIE) for r in op11.conversation_trie(df, mixed).collect()), key=repr)


def talks(seed: int, convs: int):
    rng = random.Random(seed)
    rows = []
    for i in range(convs):
        c = rng.randrange(-250, 450)
        for t in range(rng.choice([1, 1, 2, 5, 9])):
            rows.append((c, rng.choice([None, t, t]), rng.choice([None, "", "user", "a"]), rng.choice([None, "", "hi", "hi", "ünï", "x" * 50]), 1, "clash"))
    return rows + rows[:9] + [(None, 0, "user", "nobody", 1, "")]


@pytest.mark.parametrize("mixed", [False, True])
def test_trie_against_brute_force(spark, mixed):
    rows = talks(3, 260)
    assert trie_of(spark.createDataFrame(rows, CONVERSATIONS).repartition(5), mixed) == brute_trie(rows, mixed)


def test_long_conversations_cross_segments_and_windows(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for c in range(100, 130):
        same = rng.choice([0, 3, 30, 61])
        rows += [(c, t, "user" if t % 2 else "assistant", f"{t}" if t < same else f"{t} {c % 7}", 0, "") for t in range(rng.choice([2, 40, 64, 65, 90]))]
    for segment, window in ((4, 2), (16, 3), (512, 32)):
        with scratch(spark) as keep:
            convs, turns = op11.rebuilt(op11.turns_of(spark.createDataFrame(rows, CONVERSATIONS).repartition(4)))
            got = keep(op11.trie(convs, turns, segment, window), "trie").collect()
        assert sorted((tuple(r[c] for c in TRIE) for r in got), key=repr) == brute_trie(rows, True)


def test_trie_edges(spark, monkeypatch):
    assert trie_of(spark.createDataFrame([], CONVERSATIONS), True) == []
    donorless = [(c, 0, "user", "t", 0, "") for c in (7, 8, 9, 11)]  # no donor 0: turnless where h > 0
    got = trie_of(spark.createDataFrame(donorless, CONVERSATIONS), True)
    assert got == brute_trie(donorless, True) and any(crc(c) % 6 for c in (7, 8, 9, 11))
    long = [(200, 0, "user", "y" * 2_000_000, 0, "")] + [(201 + i, t, "user", "z", 0, "") for i in range(90) for t in range(7)]  # copies
    monkeypatch.setattr(op11, "PIECE", 10)
    assert trie_of(spark.createDataFrame(long, CONVERSATIONS).repartition(6), True) == brute_trie(long, True)


# --- licenses ---


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    w, found = words(text), []
    for label, phrase in op12.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


NOTICES = {label: text for label, text in op12.TEMPLATES}
LICENSED = [
    None, "", "mit", "MIT License", "the mit\nLICENSE, Apache-License cc/by CC-BY", "ÉMIT License", "mit licenseé", "mit\x00license \x7f apache\tlicense", "gnu general public license gnu general public license",
    "gnu general gnu general public license", "cc by " * 500, "Kelvin K mit license", "x" * 5, "apache " * 9, "1mit license mit license1",
]


def test_places_of_phrases_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op12, "SLICE", 7)  # grams across slices
    rng = random.Random(2)
    pieces = ["mit", "license", "apache", "cc", "by", "gnu", "general", "public", "MIT License", "é", "-", "\n", "\x7f", "word"]
    texts = LICENSED + ["".join(rng.choice(pieces) + rng.choice([" ", " ", ", ", ""]) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [(None if i % 20 == 3 else i // 2, t, "clash") for i, t in enumerate(texts)] * 2
    got = op12.license_scan(spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr) == sorted(((d, *brute_base(t)) for d, t, _ in rows), key=repr)
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and r["labels"] == ",".join(sorted(set(filter(None, r["labels"].split(",")))))
        assert (r["score"] == 1.0) if r["n_base"] else 0 <= r["score"] <= 1


def test_edited_notices_are_found_by_merged_diagonals(spark):
    rng = random.Random(4)
    filler = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    long = [(label, words(text)) for label, text in op12.TEMPLATES if len(words(text)) >= 20]
    for i, (label, notice) in enumerate(long * 3):
        edited = list(notice)
        for at in sorted(rng.sample(range(3, len(notice) - 3), len(notice) // 20), reverse=True):
            edited[at : at + 1] = rng.choice([[], ["changed"], [edited[at], "put", "in"]])
        rows.append((i, " ".join(filler(rng.randrange(40)) + edited + filler(5))))
        want[i] = label
    for i in range(20):  # pieces of notices, and their words out of order, are no notices
        label, notice = rng.choice(long)
        at = rng.randrange(len(notice) // 2)
        rows.append((1000 + i, " ".join(filler(9) + notice[at : at + len(notice) // 3] + filler(9))))
        rows.append((2000 + i, " ".join(rng.sample(notice, len(notice)))))
    rows.append((3000, "Licensed under CC BY-NC 4.0. Released under the GNU General Public License, version 3, not the Apache License, version 1.1"))
    got = {r["doc_id"]: r for r in op12.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in want.items():
        assert label in got[i]["labels"].split(",") and got[i]["score"] >= op12.SIMILAR
    for i, r in got.items():
        if 1000 <= i < 3000:
            assert not {label for label, _ in long} & set(r["labels"].split(",")) - {"gpl", "apache", "mit", "cc-by"}, (i, r)
    assert got[3000]["labels"] == "apache,cc-by,cc-by-nc,gpl,gpl-3.0" and got[3000]["base_labels"] == "apache,cc-by,gpl"


def test_license_edges(spark):
    df = "doc_id long, text string"
    assert op12.license_scan(spark.createDataFrame([], df)).collect() == []
    long = "word " * 700_000 + "MIT License " + "word " * 700_000  # over a slice on either side
    r = op12.license_scan(spark.createDataFrame([(1, long)], df)).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (1_400_002, 1, 700_000, 700_000, "mit")
    with pytest.raises(ValueError, match="fewer than"):
        op12.license_scan(spark.createDataFrame([(1, "a")], df), [("one", "word")])


def test_chains_rise_in_text_and_template():
    assert op12.chain_words([10, 11, 12, 15], [0, 1, 2, 3], 2) == 5
    assert op12.chain_words([10, 11, 12], [2, 1, 0], 2) == 2
    assert op12.chain_words([5, 5, 6], [1, 9, 2], 2) == 3 and op12.chain_words([], [], 2) == 0
