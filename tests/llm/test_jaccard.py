"""The n-gram Jaccard join: fragments, hot lists, the order's threshold, and staged tables that go."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest

from graphloom.llm import op7_jaccard_join as op7
from graphloom.llm import staging
from graphloom.session import shared_dir
from tests.llm.test_operators import brute_components


def corpus(seed: int, many: int = 90) -> list[tuple[int, str]]:
    """Edited copies of a few long and short texts, chains among them, and texts that share a passage only."""
    rng = random.Random(seed)
    words = lambda n, k: [f"w{rng.randrange(k)}" for _ in range(n)]
    bases = [words(n, 3000) for n in (6, 30, 120, 400)]
    passage = words(60, 3000)
    rows = []
    for i in range(many):
        own = list(rng.choice(bases)) if rng.random() < 0.7 else words(rng.randrange(1, 90), 3000) + passage
        for _ in range(rng.randrange(1 + len(own) // 40)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(50)}"
        rows.append((i, " ".join(own[: len(own) - rng.randrange(1 + len(own) // 12)])))
    return rows


@pytest.mark.parametrize("cuts", [1, 3, 16])
def test_overlaps_are_summed_over_any_number_of_fragments(spark, cuts, monkeypatch):
    monkeypatch.setattr(op7, "CELL_PAIRS", 3)
    monkeypatch.setattr(op7, "LIST_ROWS", 2 if cuts == 3 else 512)  # 2: lists dealt in many blocks
    rows = corpus(cuts)
    got = op7.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cuts=cuts).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_slices_follow_the_order_and_lose_nothing():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64, endpoint=False))
    names = np.sort(op7.ordered_names(h, 7, np.zeros(0, np.int64), np.zeros(0, np.uint64)))
    assert len(np.unique(names)) == len(h)
    for cuts in (1, 4, 30):
        of = op7.cut_of(names, cuts)
        assert (np.diff(of.astype(int)) >= 0).all() and of.max() < cuts and (cuts == 1 or len(np.unique(of)) > cuts // 2)
        frame = op7.pd.DataFrame({"cell": [1], "deal": [0], "cuts": [cuts], "cls": [5], "shingles": [names.astype("<u8").tobytes()]})
        parts = next(iter(op7.slice_sets(iter([frame]))))
        assert b"".join(parts["data"]) == names.astype("<u8").tobytes() and len(parts) == len(np.unique(of))


def test_frequent_shingles_come_last_in_the_range():
    h = np.arange(1, 200, dtype=np.uint64) << np.uint64(53)
    inside = h[op7.in_range(h)]
    tags = np.sort(op7.tag_of(inside[:5], 9))
    names = op7.ordered_names(inside, 9, tags, np.arange(op7.RARE_PLACES, op7.RARE_PLACES + 5, dtype=np.uint64))
    assert set(np.argsort(names)[-5:]) == set(range(5)) or len(set(tags)) < 5


def test_the_order_knows_the_most_frequent_up_to_a_bound(spark, tmp_path):
    path = str(tmp_path / "counts")
    spark.createDataFrame([(i, 8 + i % 3 * 100) for i in range(90)], "a long, b long").write.parquet(path)
    counts = spark.read.parquet(path)
    for most, want in ((1000, 90), (65, 60), (59, 30), (10, 0)):
        tags, place = op7.known_order(counts, most)
        assert len(tags) == want and (np.diff(tags) > 0).all() and (place >= op7.RARE_PLACES).all() and (place < op7.RARE_PLACES + op7.KNOWN_PLACES).all()
    tags, place = op7.known_order(counts, 1000)
    rare, often = place[tags % 3 == 0], place[tags % 3 == 2]
    assert rare.max() < often.min()


def test_heads_keep_class_size_and_postings():
    cls = np.array([-5, 1 << 50, 7], np.int64)
    short, code, k = op7.heads_from(op7.heads_of(cls, np.array([1, 500, 10**9]), np.array([1, 700, 255])))
    assert short.tolist() == [-5 & op7.SHORT, *[(1 << 50) & op7.SHORT] * 3, 7] and k.tolist() == [1, 255, 255, 190, 255]
    for n in (1, 5, 40, 999, 10**6):
        most = n * 100 // 80
        assert op7.size_code(np.array([most]))[0].astype(int) - op7.size_code(np.array([n]))[0].astype(int) <= op7.code_reach(80)


def test_ends_are_where_no_larger_partner_can_link():
    rng = np.random.default_rng(4)
    of, n = np.sort(rng.integers(0, 6, 200)), rng.integers(1, 60, 200)
    order = np.lexsort((n, of))
    of, n = of[order], n[order]
    at = (rng.random(200) * n * 0.2).astype(int)
    end = op7.ends_of(of, n, at, 80)
    for i in range(200):
        can = [j for j in range(i + 1, 200) if of[j] == of[i] and 100 * n[i] >= 80 * n[j] and op7.reaches(n[i], at[i], n[j], 0, 80)]
        assert all(j < end[i] for j in can) and (end[i] == 200 or of[min(end[i], 199)] >= of[i])


def test_a_set_with_too_few_shared_shingles_of_the_range_leaves(spark, tmp_path):
    for name, rows, cols in (("classes", [(1, 10, 100, 40), (2, 11, 100, 40), (3, 12, 5, 1), (4, 13, 5, 3)], "cls long, rep long, n long, m long"), ("shared", [(1, 20), (2, 19)], "short long, shared long")):
        spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / name))
    got = op7.alive_classes(spark.read.parquet(str(tmp_path / "classes")), spark.read.parquet(str(tmp_path / "shared")), 80)
    assert sorted(r["cls"] for r in got.collect()) == [1, 3]


def test_staged_tables_go_but_for_what_the_result_reads(spark):
    root = Path(shared_dir(spark).removeprefix("file:")) / "graphloom"
    before = set(root.iterdir()) if root.exists() else set()
    df = spark.createDataFrame(corpus(9, 30), "doc_id long, text string")
    out = op7.jaccard_components(df)
    assert out.count() == 30 and len(set(root.iterdir()) - before) == 1
    with pytest.raises(ZeroDivisionError), staging.scratch(spark):
        staging.stage(df, "lost")
        1 / 0  # noqa: B018
    assert len(set(root.iterdir()) - before) == 1


def test_a_hot_row_repeated_many_times(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(7, text)] * 300 + [(8, text + " x"), (9, "own words " + " ".join(f"z{i}" for i in range(40)))]
    got = op7.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted({(r["doc_id"], r["component_id"], r["copies"]) for r in got}) == [(7, 7, 300), (8, 7, 1), (9, 9, 1)] and len(got) == 302


def test_members_of_long_lists_meet_in_some_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op7, "LIST_ROWS", 4)
    tables = {}
    for name, rows, cols in (
        ("lists", [(5, 10, 0, k, 30) for k in range(30)] + [(6, 10, 0, k, 3) for k in range(3)], "value long, n int, place int, cls long, m long"),
        ("label", [(k, 0 if k < 24 else k) for k in range(30)], "cls long, component long"),
        ("extra", [(k, bytes(op7.SKETCH_BITS // 8), 1) for k in range(30)], "cls long, sketch binary, cell long"),
    ):
        spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    dealt = op7.dealt_lists(tables["lists"], tables["label"], tables["extra"], True)
    sizes = {(r["value"], r["block"]): r["n"] for r in dealt.groupBy("value", "block").agg(op7.F.count("*").alias("n")).collect()}
    assert sizes[6, 0] == 3 and sum(n for (v, _), n in sizes.items() if v == 5) == 24 * 2 + 6 * (2 + 6) and max(sizes.values()) < 20
    rows = [(r["a"], r["b"]) for r in dealt.mapInPandas(op7.cross_pairs(80), op7.PAIRS).collect()]
    assert sorted(rows) == [(a, b) for a in range(30) for b in range(a + 1, 30) if b >= 24]
    next_to = op7.dealt_lists(tables["lists"], tables["label"], tables["extra"], False)
    assert next_to.count() == 33


def test_small_sets_link_with_their_equals_only(spark):
    rows = [(i, f"see the licence page {i} w{i}") for i in range(40)] + [(100 + i, "one and the same six words") for i in range(3)] + [(200, "a b c d e f g h"), (201, "a b c d e f g h i"), (202, "a b c d e f g x")]
    got = op7.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
    assert {r["component_id"] for r in got if r["doc_id"] in (200, 201)} == {200}  # 4 of 5 in common


def boilerplate(n: int, common: int, own: int) -> list[tuple[int, str]]:
    """Texts that hold one passage and words of their own."""
    passage = " ".join(f"p{k}" for k in range(common))
    return [(i, f"{passage} " + " ".join(f"u{i}x{k}" for k in range(own))) for i in range(n)]


@pytest.mark.parametrize("common", [14, 60])
def test_rows_dealt_for_a_passage_of_all_texts_grow_with_the_texts(spark, monkeypatch, common):
    monkeypatch.setattr(op7, "LIST_ROWS", 32)
    deal, dealt = op7.dealt_lists, []

    def counting(lists, label, extra, whole):
        out = deal(lists, label, extra, whole)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(op7, "dealt_lists", counting)
    sums = []
    for n in (300, 1200):
        dealt.clear()
        rows = boilerplate(n, common, common // 3 * 2) + [(10_000 + n, boilerplate(1, common, common // 3 * 2)[0][1] + " more")]
        got = {r["doc_id"]: r["component_id"] for r in op7.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        assert got == {i: 0 if i in (0, 10_000 + n) else i for i, _ in rows}
        sums.append(sum(dealt))
    assert sums[1] <= 5 * sums[0] + 200


def test_members_of_long_lists_are_listed_again_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(op7, "LIST_ROWS", 3)
    monkeypatch.setattr(op7, "RANGE", 0.4)
    rng = random.Random(12)
    rows = boilerplate(25, 40, 30)
    for i in range(60):
        own = rng.choice(rows[:25])[1].split()
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(9)}"
        rows.append((100 + i, " ".join(own)))
    got = op7.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
