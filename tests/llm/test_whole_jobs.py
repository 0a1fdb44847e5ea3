"""Cases in which an operator could do less than its whole job."""

from __future__ import annotations

import time

import pytest

from graphloom.llm import op3_sentencepiece as op3
from graphloom.llm import op4_warc as op4
from graphloom.llm import op6_language_id as op6
from graphloom.llm import op7_jaccard_join as op7
from graphloom.llm import op9_page_differencing as op9


def test_deduplicate_tells_texts_of_one_doc_id_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(3, a, 0), (5, a, 0), (5, b, 0), (9, b, 0)] + [(11, f"clean text number {i} of its own", i) for i in range(20)] + [(11, "clean text number 0 of its own", 0), (11, None, 0), (11, "", 0), (12, a.upper(), 0), (12, "one more text of this id", 0)]
    kept = op7.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, cls int").repartition(3))
    assert kept.columns == ["doc_id", "text", "cls"]
    got = sorted((r["doc_id"], r["text"] or "") for r in kept.collect())
    assert got == sorted([(3, a), (5, b), (11, ""), (12, "one more text of this id")] + [(11, f"clean text number {i} of its own") for i in range(20)])


def test_warc_decides_each_payload_of_a_page_id(spark):
    hot, other, small, own = "h" * 3000, "o" * 2000, "small", "u" * 5000
    rows = [(7, "u1", hot), (7, "u2", other), (7, "u3", small), (7, "u4", own), (8, "v", hot), (9, "w", other), (9, "w", small)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in op4.read_warc(op4.write_warc(pages)).collect())
    assert got == [(7, 5, "response", None), (7, 2000, "revisit", 9), (7, 3000, "revisit", 8), (7, 5000, "response", None), (8, 3000, "response", None), (9, 5, "response", None), (9, 2000, "response", None)]


def test_scripts_end_at_their_closing_tag():
    text = lambda page: [t for _, t in op9.blocks_of(page)]
    assert text("<p>a</p><script>for(i=0;i<n;i++){f()}</script><p>b</p><script>x</script><p>c</p>") == ["a", "b", "c"]
    assert text("<p>a</p><script>var a='<!--'; b='</div>'</SCRIPT ><p>b</p>") == ["a", "b"]
    assert text("<style>a<b{}</style><title>1 <2 </title><p>a<svg><style>x<y</style><title>t</title></svg></p>b<textarea><!--</textarea>c") == ["a", "bc"]
    assert text("<p>a</p><script>if(a<b)<p>open</p>") == ["a"] and text("<svg><title>x</svg><p>a</p>") == ["a"]


def test_large_templates_are_deleted_and_copies_kept(spark):
    menu, foot = "".join(f"<li>Menu entry {i}</li>" for i in range(14)), "".join(f"<div>Foot line {i}</div>" for i in range(6))
    page = lambda lines: f"<body><table><tr><td>{menu}</td></tr></table>{''.join(f'<div>{x}</div>' for x in lines)}{foot}</body>"
    story = lambda i: [f"Story {i} has a line {k}" for k in range(3)]
    rows = [(i, f"http://a.org/s/{i:02}", page(story(i))) for i in range(12)]
    rows += [(100 + i, f"http://b.org/s/5?session={i}", page([*story(105), f"Seen {i}"])) for i in range(9)] + [(110 + i, f"http://b.org/s/{i}", page(story(110 + i))) for i in (1, 2, 8, 9)]  # near copies under one path
    rows += [(200 + i, f"http://c.org/p/{i:02}", page(story(200))) for i in range(9)] + [(220 + i, f"http://c.org/z/{i}", page(story(220 + i))) for i in range(4)]  # copies under several paths
    rows += [(300, "http://d.org/1", page(story(300))), (301, "http://d.org/2", page(story(300)))]  # nothing shows the template
    want = {i: " ".join(story(105) + [f"Seen {i - 100}"] if 100 <= i < 110 else story(200 if 200 <= i < 210 else i)) for i, *_ in rows if i < 300}
    for n in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            got = {r["page_id"]: r["text"] for r in op9.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert {i: t for i, t in got.items() if i < 300} == want
        assert all(" ".join(story(300)) in got[i] for i in (300, 301))


def test_every_language_is_learned(spark, monkeypatch):
    words = lambda letters, n: " ".join(letters[i % len(letters)] + letters[i * i % len(letters)] + letters[i // 3 % len(letters)] for i in range(n))
    own = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst"}
    rows = [(i, words(own["aa"], 900 + i), "aa") for i in range(40)]  # many texts, each a small part
    rows += [(50, words(own["aa"], 90_000), "aa"), (1001, words(own["bb"], 60), "bb")]  # a long one; a single small one
    rows += [(1100 + i, words(own["cc"], 60_000 + i), "cc") for i in range(4)]  # each larger than the sample
    rows += [(1203, words(own["dd"], 50 + i), "dd") for i in range(60)] + [(1204, "123 456", "ee")]  # one doc_id
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = {r["doc_id"] for r in docs.filter(op6.held_out()).collect()}
    assert not fold & {1001, 1203} and any(i not in fold for i in range(1100, 1104))
    for sample in (2000, 20_000):
        models = op6.learn(docs, sample, sample // 4)
        assert models.languages == sorted(own)
        got = models.predict([op6.normalise(words(x, 40)) for x in own.values()])
        assert got[0] == list(own) and not got[2].any()
    assert sum(op6.identify(docs.filter("lang in ('bb', 'cc')")).toPandas()["rejected"]) == 0


def test_sample_follows_the_hash_and_calibration_other_documents():
    frame = op6.pd.DataFrame({"lang": "x", "doc_id": [1, 1, 2, 3, 4], "text": ["a" * 10, "b" * 10, "c" * 10, "d" * 10, "e" * 10], "u": [0.1, 0.3, 0.2, 0.4, 0.5]})
    got = op6.draw(frame, 15, 15)
    assert sorted(zip(got["text"].str[0], got["calibration"])) == [("a", False), ("c", False), ("d", True), ("e", True)]
    one = op6.draw(frame[:1], 1, 100)
    assert one["calibration"].tolist() == [False]


def test_every_segment_is_compared_with_the_reference(monkeypatch):
    own = op3.Codec(open(op3.MODEL, "rb").read())
    assert own.checks_segments
    own.encode(["", " ", "a  b▁ ", "▁▁x", "日本 \n 😀 <0x41> <s> <unk>", "one two"])
    real, wrong = own.encode_segments, op3.np.array([5, 6], op3.np.int32).tobytes()
    monkeypatch.setattr(own, "encode_segments", lambda new: [wrong if s == "odd" else x for s, x in zip(new, real(new), strict=True)])
    assert len(own.encode(["even more"])) == 1
    with pytest.raises(ValueError, match="odd"):
        own.encode(["first text", "an odd text"])
    assert "odd" not in own.known


def test_revisits_refer_to_a_response_with_their_payload(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 2000), (2, "u", "x" * 2000), (None, "v", "y" * 1500)], "page_id long, url string, html string")
    archives = op4.write_warc(pages)
    assert sorted((r["page_id"] or 0, r["refers_to"]) for r in op4.read_warc(archives).collect()) == [(0, None), (1, 2), (2, None)]
    read = spark.createDataFrame([(1, 2000, "aa", "revisit", 2), (2, 2000, "bb", "response", None)], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    with pytest.raises(Exception, match="refers to no response"):
        op4.resolved(read).collect()


def test_archives_roll_by_raw_bytes_and_long_payloads(spark):
    pages = spark.createDataFrame([(i, "u", "a" * 3_000_000 + str(i)) for i in range(14)] + [(90, "u", None)], "page_id long, url string, html string").coalesce(1)
    archives = op4.write_warc(pages.withColumn("content", op4.F.lit(1)).withColumn("archive", op4.F.lit("x")))
    assert archives.count() >= 2  # far below ARCHIVE bytes when compressed
    assert sorted((r["page_id"], r["payload_bytes"]) for r in op4.read_warc(archives).collect()) == [(i, 3_000_000 + len(str(i))) for i in range(14)] + [(90, 0)]
    assert op4.read_warc(op4.write_warc(pages.withColumn("page_id", op4.F.lit(None).cast("long")))).count() == 15


def test_names_of_boxes_count_whole_and_little_inside_articles():
    text = lambda page: [t for _, t in op9.blocks_of(page)]
    assert text("<article><p class='related work'>a</p><div id='search-results'>b</div><p>x <math><mi>y</mi></math></p><div class='big ad'>no</div><div class=comments>no</div><div class='menu card'>c</div></article>") == ["a", "b", "x y", "c"]
    assert text("<div class='promotion'>a</div><div class='menu'>no</div><p class='share'>no</p><p class='share holders'>b</p>") == ["a", "b"]
    assert text("<header><div><h1>Title</h1><p>no</p></div></header><p>a</p>") == ["Title", "a"]
    assert text("<header><h1>Site</h1></header><article><header><h1>Own</h1></header>a</article>") == ["Own", "a"]


def test_differencing_does_without_markup(spark):
    """The same texts where every element of the site is a plain div."""
    menu, foot = "".join(f"<li>Entry {i}</li>" for i in range(7)), "".join(f"<p>Foot {i}</p>" for i in range(3))
    story = lambda i: f"<p>Story {i} opens</p><p>and story {i} closes</p>"
    marked = [(i, f"http://a.org/s/{i:02}", f"<body><nav class=menu><ul>{menu}</ul></nav><header class=top><p>Our site</p></header><article>{story(i)}</article><footer>{foot}</footer></body>") for i in range(9)]
    plain = [(i, u, op9.re.sub(r"<(/?)[a-z]+[^>]*>", r"<\1div>", page)) for i, u, page in marked]
    texts = [{r["page_id"]: r["text"] for r in op9.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()} for rows in (marked, plain)]
    assert texts[0] == texts[1] == {i: f"Story {i} opens and story {i} closes" for i in range(9)}


def test_differencing_against_brute_force(spark):
    """Every line that a page shares, in order, with one of the two different pages next to it on each side goes."""
    import random

    rng = random.Random(5)
    rows = [[f"Menu {k}" for k in range(rng.randrange(3, 6))] + [f"line {rng.randrange(60)} of the pool" for _ in range(rng.randrange(6, 14))] + ["Foot"] for _ in range(30)]

    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0]

    pages = spark.createDataFrame([(i, f"http://h.org/{i:03}", "".join(f"<div>{x}</div>" for x in lines)) for i, lines in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in op9.extract_main_text(pages.repartition(5)).collect()}
    for i, lines in enumerate(rows):
        near = [rows[k] for k in (i - 2, i - 1, i + 1, i + 2) if 0 <= k < len(rows)]
        text, shared = got[i]
        assert max(lcs(lines, other) for other in near) <= shared <= sum(lcs(lines, other) for other in near)
        left = [x for x in lines if x in text]
        assert "Foot" not in left and not any(x.startswith("Menu 0") for x in left)
        assert all(any(x in other for other in near) for x in set(lines) - set(left))
    assert sum(n for _, n in got.values()) > 100


def test_kneser_ney_against_a_dictionary():
    texts = ["abra cadabra", "a barb and a crab", "cab"]
    pad = chr(op6.PAD) * (op6.ORDER - 1)
    seen = [pad + t for t in texts]
    grams = {k: [s[i - k + 1 : i + 1] for s in seen for i in range(op6.ORDER - 1, len(s))] for k in range(1, op6.ORDER + 1)}
    counts = {op6.ORDER: {g: grams[op6.ORDER].count(g) for g in grams[op6.ORDER]}}
    for k in range(1, op6.ORDER):
        longer = set(grams[k + 1])
        counts[k] = {g: sum(x[1:] == g for x in longer) for g in grams[k]}

    def discount(k):
        n1, n2 = (sum(c == n for c in counts[k].values()) for n in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        same = [c for g, c in counts[k].items() if g[:-1] == gram[:-1]]
        if not same:
            return lower
        d = discount(k)
        return max(counts[k].get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * lower

    models = op6.fit(op6.pd.DataFrame({"lang": "a", "text": texts, "calibration": False}))
    for text in ("abra", "crab cab", "zebra", "q", "dab a cad"):
        s = pad + text
        want = -sum(op6.np.log(p(s[i - op6.ORDER + 1 : i + 1])) for i in range(op6.ORDER - 1, len(s))) / len(text)
        assert abs(models.entropies([text])[0, 0] - want) < 1e-4, text
    for context in ("", "a", "ca", "zz"):
        s = (pad + context)[-(op6.ORDER - 1) :]
        assert abs(sum(p(s + c) for c in counts[1]) + p(s + "\0") - 1) < 1e-9  # one place is left for what was not seen


def test_unknown_languages_and_noise_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = op6.learn(docs)
    odd = ["Это предложение написано на русском языке и должно быть отклонено моделью", "これは日本語で書かれた文章ですから却下されるはずです", "αυτή η πρόταση είναι γραμμένη στα ελληνικά και πρέπει να απορριφθεί", "xkqz wvbk zzqj kxvw qqjz vkxb wqzk jxqv bkzw qvxj zkqw", "هذه الجملة مكتوبة باللغة العربية ويجب رفضها"]
    _, _, rejected = models.predict([op6.normalise(t) for t in odd])
    assert rejected.all()
    known = [r["text"] for r in docs.filter("lang is not null and length(text) > 200").select("text").limit(200).collect()]
    assert models.predict([op6.normalise(t) for t in known])[2].mean() <= 0.01


def test_mix_copies_equal_rows_and_keeps_others_apart(spark):
    from collections import Counter

    from graphloom.llm import op8_mixing as op8

    hot = [(1, "one two three", "en", "a", 0)] * 300
    rows = hot + [(1, "one two three", None, "a", 0), (1, "one two three", "en", None, 0), (None, "four five", "en", "b", 1), (None, "four five", "de", "b", 1), (2, None, "en", "b", 2), (3, "six " * 50_000, "en", "c", 3)] + [(10 + i, f"word {i} and more", "en", "b", 4) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies long").repartition(5)
    want = Counter(rows)
    runs = [Counter(tuple(r) for r in op8.mix(docs).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and all(n <= 2 * want[r] for r, n in runs[0].items())
    targets = {r["source"]: r["target"] for r in op8.decide(docs).select("source", "target").distinct().collect()}
    for source, target in targets.items():
        taken = [(r, n) for r, n in runs[0].items() if r[3] == source]
        assert abs(sum(len((r[1] or "").split()) * n for r, n in taken) - target) <= max((len((r[1] or "").split()) for r, _ in taken), default=0)
    assert op8.mix(docs).columns == docs.columns


def test_pipeline_stages_on_odd_and_empty_tables(spark, sf_dir, tmp_path):
    import corpus_pipeline

    learned = [(100 + i, f"the words of this english text number {i} are plain and many of them are common words", "en", "a", 0, "x", 1) for i in range(30)]
    long = "the words of this english text are plain and many of them are common words " * 3000
    odd = [(1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 1), (3, "12 !", "en", "a", 0, "x", 1), (4, learned[0][1], "en", None, None, None, None), (4, learned[0][1], "en", None, None, None, None), (None, "the words of this english text without number are plain and many of them are common", "en", "a", 1, "y", 2), (5, long, None, "b", 2, "z", 3)]
    cols = "doc_id long, text string, lang string, source string, n_chars long, cls string, _copies int"
    for name, rows in (("odd", learned + odd), ("none", [])):
        docs = spark.createDataFrame(rows, cols).repartition(3)
        for stage, function in corpus_pipeline.STAGES:
            out = function(spark, docs, sf_dir)
            assert stage == "tokens" or out.columns == docs.columns
            out.write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
            got = [r["doc_id"] for r in docs.collect()]
            assert rows or not got
            if rows and stage == "language":
                assert not {1, 2, 3} & set(got) and {4, 5, None, 100} <= set(got) and got.count(4) == 2
            elif rows and stage == "near_duplicates":
                assert 4 in got and got.count(4) == 1 and {5, None} <= set(got) and 100 not in got
            elif rows and stage == "tokens":
                assert all(r["round_trip"] for r in docs.collect())


def test_numbers_are_no_letters():
    assert [op6.normalise(t) for t in ("²", "½ ①", "Ⅷ", "12_3", "", None)] == [""] * 6
    assert [op6.normalise(t) for t in ("a²", "日本", "É!")] == ["a²", "日本", "é"]


@pytest.mark.parametrize("page", ["x<" + "a" * 400_000, '<a "' * 50_000, "<a b" * 100_000, "<div>" * 50_000 + "</b>" * 50_000, "<!-" * 50_000, "<a '\"" * 50_000 + ">"])
def test_long_broken_pages_are_read_in_linear_time(page):
    began = time.process_time()
    op9.blocks_of(page)
    assert time.process_time() - began < 10


def test_a_tag_without_an_end_is_text():
    assert op9.blocks_of("<p>one</p> a <b c") == [(op9.OPEN, "one"), (op9.OPEN, "a <b c")]
    assert op9.blocks_of("<p>one</p> a <!-- b") == [(op9.OPEN, "one"), (op9.OPEN, "a")]


def test_furniture_inside_a_landmark_and_comments_by_their_names():
    text = lambda page: [t for _, t in op9.blocks_of(page)]
    assert text("<main><ul class='main-menu'><li>no</li></ul><div class=sidebar>no</div><div class='cookie-notice'>no</div><div class=newsletter>no</div><h1>T</h1><p>a</p><div class=menu>b</div></main>") == ["T", "a", "b"]
    for name in ("ad-box", "advertisement-top", "user-comments", "comment-thread", "replies", "comments2", "comment", "reader_comments", "ad1", "google-ads"):
        assert text(f"<article><p>a</p><div class='{name}'>no</div><div id='{name}'>no</div></article><div class='{name}'>no</div>") == ["a"], name
    for name in ("adventure", "commentary", "address", "advice", "read", "add-on", "header-image", "commented"):
        assert text(f"<article><p>a</p><div class='{name}'>b</div></article>") == ["a", "b"], name
    assert text("<main><p>a</p><article class=comment>no</article><p style='display: none'>no</p><div style='color:red'>b</div></main>") == ["a", "b"]


def test_texts_do_not_depend_on_how_the_input_is_cut(spark):
    import random

    rng = random.Random(8)
    menu = "".join(f"<div>Entry {k}</div>" for k in range(4))
    rows = [(i, f"http://q.org/list?id={i % 25}", f"<body>{menu}" + "".join(f"<div>line {rng.randrange(40)}</div>" for _ in range(8)) + f"<div>Own {i}</div></body>") for i in range(60)]
    texts = []
    for n, parts in ((1, 1), (4, 7), (9, 3)):
        rng.shuffle(rows)
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
            texts.append({r["page_id"]: r["text"] for r in op9.extract_main_text(df).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert texts[0] == texts[1] == texts[2]


def test_queries_in_threads_of_one_session_leave_each_other_alone(spark, sf_dir):
    from concurrent.futures import ThreadPoolExecutor

    from graphloom.llm import queries
    from graphloom.llm.staging import release

    names = ["op4_warc", "op8_mixing", "op10_media_sequences", "op13_merkle_manifest"]
    rows = lambda name: sorted(map(str, queries.REGISTRY[name](spark, sf_dir).collect()))
    want = {name: rows(name) for name in names}
    with ThreadPoolExecutor(4) as pool:
        for _ in range(2):
            assert dict(zip(names, pool.map(rows, names), strict=True)) == want
    assert release(spark) >= 12 and release(spark) == 0


def test_a_pipeline_that_fails_leaves_no_table(spark, sf_dir, monkeypatch):
    from pathlib import Path

    import corpus_pipeline
    from graphloom.session import shared_dir

    def die(*_):
        raise ZeroDivisionError

    root = Path(shared_dir(spark).removeprefix("file:")) / "graphloom"
    root.mkdir(exist_ok=True)
    before = set(root.rglob("*.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[2], ("dies", die)])
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, sf_dir)
    assert not [p for p in set(root.rglob("*.parquet")) - before if "pipeline-" in str(p)]


def test_languages_that_were_not_learned_are_rejected_in_the_same_script(spark):
    """Labelled texts of the table are invented German, English, Spanish and French; these are others, in Latin letters."""
    models = op6.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    foreign = [
        "De kat zit op de mat en kijkt naar buiten waar het hard regent terwijl de kinderen op straat spelen en lachen",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki",
        "Watu wote wamezaliwa huru hadhi na haki zao ni sawa wote wamejaliwa akili na dhamiri",
    ]
    assert models.predict([op6.normalise(t) for t in foreign * 3])[2].all()


@pytest.mark.parametrize("roll", [1, 3, 8])
def test_shards_are_the_shortest_prefixes_that_fit(spark, monkeypatch, roll):
    """Against splitting by the definition: a bucket that is too large goes on with one more bit."""
    from graphloom.llm import op5_sharding as op5

    monkeypatch.setattr(op5, "ROLL", roll)
    monkeypatch.setattr(op5, "SLACK_BITS", 9 if roll == 3 else 5)
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 211)) for i in range(500)], "doc_id long, text string").repartition(3)
    for limit in (300, 5000, 10**6):
        rows = op5.shard(docs, limit).collect()
        hashes = {i: format(h, "060b") for i, h in docs.select("doc_id", op5.hash_bits(op5.F.col("doc_id"))).collect()}

        def split(ids, depth, limit=limit, hashes=hashes):
            if sum(i * 37 % 211 for i in ids) <= limit or len(ids) == 1:
                return dict.fromkeys(ids, hashes[ids[0]][:depth])
            return {k: v for bit in "01" if (part := [i for i in ids if hashes[i][depth] == bit]) for k, v in split(part, depth + 1).items()}

        assert {r["doc_id"]: r["shard"] for r in rows} == split(list(range(500)), 0)
