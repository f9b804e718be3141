import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from wrackline.operators import blocks as B
from wrackline.operators import compare as C
from wrackline.operators import dedup as D
from wrackline.operators import prepare as R
from wrackline.operators import sequences as S


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_blocks_and_chunks(spark):
    prose = "The council met on Monday and agreed that the new plan would go ahead at once."
    text = f"<!-- page -->\n\n## Big news\n\n{prose}\n\nBy Jane Doe\n\n## Other news\n\n{prose} {prose}\n\nPage 4\n\n## Trailing"
    found = B.blocks(B.candidates(spark.createDataFrame([("e", text)], "source string, text string")))
    assert [(r.text[:10], r.is_heading) for r in found.orderBy("idx").collect()] == [("Big news", True), (prose[:10], False), ("Other news", True), (prose[:10], False), ("Trailing", True)]
    made = B.chunks(found, 1, 20).orderBy("ordinal").collect()
    assert [r.content for r in made] == [f"Big news\n\n{prose}", f"Other news\n\n{prose}", prose]
    with pytest.raises(ValueError):
        B.chunks(found, 250, 100)


def test_pieces_keep_words():
    text = " ".join(f"w{i}" for i in range(25))
    assert [len(p.split()) for p in B.pieces(text, 10)] == [10, 10, 5]
    assert B.pieces("A b c. D e f. G.", 4) == ["A b c.", "D e f. G."]


def test_longest_of_copies(spark):
    df = spark.createDataFrame([("b", 0, "Same  text"), ("a", 0, "same text"), ("a", 1, "other"), ("a", 2, None)], "source string, ordinal int, content string")
    assert sorted(r.content or "" for r in D.longest_of_copies(df).collect()) == ["", "Same  text", "other"]


def test_first_of_near_is_greedy_not_components(spark):
    ranked = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "id bigint, rank int")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint")
    assert sorted(r.id for r in D.first_of_near(ranked, pairs).collect()) == [1, 3, 4]
    draw = random.Random(3)
    edges = {tuple(sorted(draw.sample(range(40), 2))) for _ in range(60)}
    kept = []
    for i in range(40):
        if not any((k, i) in edges for k in kept):
            kept.append(i)
    ranked = spark.createDataFrame([(i, i) for i in range(40)], "id bigint, rank int")
    assert sorted(r.id for r in D.first_of_near(ranked, spark.createDataFrame(sorted(edges), "a bigint, b bigint")).collect()) == kept


def test_reasons(spark):
    good = '{"messages":[{"role":"assistant","content":"x"}]}'
    cases = {good: None, "nope": "not JSON", "[1]": "not an object", "{}": "no messages", '{"messages":[]}': "no messages", '{"messages":[{"role":"user","content":"x"}]}': "role is not assistant", '{"messages":[{"role":"assistant","content":42}]}': "content is not text", '{"messages":[{"role":"assistant","content":"  "}]}': "content is blank"}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r.raw: r.why for r in df.select("raw", R.reason(F.col("raw")).alias("why")).collect()} == cases
    lines = spark.createDataFrame([("s", 1, good)], "shard string, line_no bigint, raw string")
    assert R.validated(lines).first()["content"] == "x"
    with pytest.raises(Exception, match="not JSON"):
        R.validated(spark.createDataFrame([("s", 1, "nope")], "shard string, line_no bigint, raw string")).collect()
    bad = spark.createDataFrame([("s", 7, next(k for k, v in cases.items() if v == "role is not assistant"))], "shard string, line_no bigint, raw string")
    # whatever is read of them, bad lines fail the job
    for use in (lambda d: d.select("digest", "tokens", "content").collect(), lambda d: d.count(), lambda d: d.select("shard").collect()):
        with pytest.raises(Exception, match="s:7: role is not assistant"):
            use(R.validated(bad))
    assert R.validated(bad, quarantine=True).first()["reason"] == "role is not assistant"


def test_window_and_split(spark):
    from wrackline.functions.text import sha256

    raw = [("a", i, "x" * (100 + i % 60)) for i in range(200)]
    df = spark.createDataFrame(raw, "shard string, line_no int, content string").withColumn("digest", sha256(F.concat("content", F.lit(" "), (F.col("line_no") % 150).cast("string")))).withColumn("tokens", F.length("content"))
    seen = R.windowed(df)
    assert seen.count() == df.select("digest").distinct().count()
    kept = seen.where("status = 'kept'")
    split = R.with_split(kept, 0.1)
    assert split.where("split = 'eval'").count() == round(kept.count() * 0.1)
    assert R.summary(df, seen, split).first()["total_records"] == 200


def test_comparison(spark):
    base = spark.createDataFrame([(1, "local", "f", "g", [0.1, 0.2, 0.0, 0.0], 0), (2, "control", "h", "g", [0.5, 0.5, 0.1, 0.1], 0)], "probe_id int, track string, fact_id string, source_group string, scores array<double>, answer_index int")
    better = base.withColumn("scores", F.when(F.col("probe_id") == 1, F.array(F.lit(0.9), F.lit(0.2), F.lit(0.0), F.lit(0.0))).otherwise(F.col("scores")))
    pairs = C.paired(C.outcomes(base), C.outcomes(better), ("track", "fact_id", "source_group"), strict=True)
    got = {(r.dimension, r.value): r for r in C.grouped(pairs, ("track",)).collect()}
    assert got["overall", None].n == 2 and got["track", "local"].wins == 1 and got["track", "control"].ties == 1
    assert {r.family: r.change for r in C.families(pairs).collect()} == {"f": "acquired", "h": "same"}
    assert C.contrasts(pairs).first()["adjusted_delta"] == pytest.approx(0.8)
    with pytest.raises(ValueError):
        C.paired(C.outcomes(base), C.outcomes(better.limit(1)), ("track",), strict=True)
    low, high = pairs.agg(C.bootstrap(F.col("delta"), F.col("probe_id")).alias("i")).select("i.*").first()
    assert 0 <= low <= high <= 0.8 + 1e-9


def test_membership(spark):
    probes = spark.createDataFrame([("a", "local", ["1"]), ("b", "local", ["1", "2"]), ("c", "local", []), ("d", "control", []), ("e", "local", ["9"]), ("f", "local", ["2"])], "id string, track string, source_digests array<string>")
    side = lambda *d: spark.createDataFrame([(x,) for x in d], "digest string")
    assert dict(rows(C.membership(probes, side("1"), side("1", "2")))) == {"a": "train", "b": "mixed", "c": "mixed", "d": "control", "e": "absent", "f": "eval"}


def test_windows(spark):
    df = spark.createDataFrame([("a", 104.2), ("b", 0.0), ("c", 12.0), ("d", 55.0)], "recording_id string, duration_s double")
    got = S.sliding(df).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.max("end_s")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {"a": (4, 104.2), "c": (1, 12.0), "d": (2, 55.0)}


def test_stitching(spark):
    assert S.continuation("the ship came in at noon".split(), "came in at noon with rum".split()) == ["with", "rum"]
    assert S.continuation("a b c".split(), "x y z".split()) == ["x", "y", "z"]
    assert not S.acceptable("x", "one two three four five", [])
    df = spark.createDataFrame([("r", 1, "in at noon with rum", 3, 5), ("r", 0, "the ship came in at noon", None, 7)], "recording_id string, index int, transcript string, generation_tokens int, latency_ms bigint")
    assert rows(S.stitched(df).drop("steps")) == [("r", "the ship came in at noon with rum", 0, 3, 12)]
    offered = S.stitched(df, lambda context, chunk: "noon with rum").first()
    assert offered.accepted == 1 and [tuple(x) for x in offered.steps] == [(1, "noon with rum", "with rum", True)]


def test_continuation_against_plain_loop():
    def plain(before, words, most=60, least=0.72):
        reach, drop, span, best = min(most, len(before), len(words)), 0, 0, 0.0
        for n in range(2, reach + 1):
            for m in range(max(2, n - 4), min(reach, n + 4) + 1):
                like = SequenceMatcher(None, S._key(before[-n:]), S._key(words[:m])).ratio()
                if like >= least and (like > best + 0.02 or abs(like - best) <= 0.02 and min(n, m) > span):
                    drop, span, best = m, min(n, m), like
        return words[drop:]

    draw = random.Random(7)
    several = ["a", "the", "sea", "-", "don't", "straße", "Ünï", "\U0001d400", "no", "no.", "committee", *("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 9))) for _ in range(40))]
    for trial in range(60):
        among = draw.sample(several, draw.choice([2, 4, 20, len(several)]))
        before = draw.choices(among, k=draw.choice([1, 5, 30, 70]))
        words = before[-draw.choice([1, 3, 10, 45, 60]) :] + draw.choices(among, k=draw.randint(0, 30))
        for _ in range(draw.choice([0, 0, 1, 3, 8])):
            at = draw.randrange(len(words))
            words[at : at + 1] = draw.choice([["sea"], draw.choices(among, k=2), [words[at] + "s"]])
        assert S.continuation(before, words) == plain(before, words), trial


def test_stitching_measures_few_pairs_in_many_tasks(spark, monkeypatch):
    draw, measured = random.Random(3), []
    for name in ("ratio", "quick_ratio"):
        monkeypatch.setattr(SequenceMatcher, name, lambda self, real=getattr(SequenceMatcher, name): measured.append(1) or real(self))
    for _ in range(20):
        text = ["".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 9))) for _ in range(110)]
        assert len(S.continuation(text[:60], text[50:])) < 60
        S.continuation(text[:50], text[50:])
    assert len(measured) <= 40 * 5  # of some 500 pairs at each boundary
    rows = spark.range(400).selectExpr("cast(id % 100 as string) recording_id", "cast(id / 100 as int) index", "'some words' transcript", "1 generation_tokens", "1L latency_ms")
    assert S.stitched(rows).select(F.spark_partition_id().alias("p")).distinct().count() == 4


def test_folds_and_plans(spark):
    items = spark.createDataFrame([("k", i, s) for i, s in enumerate([4, 4, 3, 20, 1])], "k string, i int, s int")
    assert [r.bin for r in S.packed(items, "k", "i", "s", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    files = spark.createDataFrame([("f", 25)], "name string, total bigint")
    assert sorted(rows(S.ranges(files, 10))) == [("f", 0, 9), ("f", 10, 19), ("f", 20, 24)]
    one = spark.createDataFrame([("r", 1, ["a"])], "id string, x int, y array<string>")
    two = spark.createDataFrame([("r", 2, ["a"])], "id string, x int, y array<string>")
    assert [r.field for r in S.differing(one, two, "id").collect()] == ["x"]
    samples = spark.sql("select 'r' as run, timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,t) as ts, w from values (0, 50.0), (10, 0.0), (20, 60.0), (25, 60.0) v(t, w)")
    assert S.metered(samples, "run", "ts", "w").agg(F.max("consumed_s")).first()[0] == 15.0
    looks = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("q", "a", 1)], "run_id string, path string, size int")
    assert rows(S.complete(looks, looks, ["a", "b"])) == [("r",)]


def test_literal_transcripts_have_all_windows(spark, tmp_path):
    from wrackline.plans import catalogue

    draw = random.Random(5)
    ends = [0.05, 0.25, 0.75, 2.25, 119.85, 129.95, 30.0, 55.5, 1.005, 1234.45, 99.95, 0.04, *(round(draw.uniform(0, 4000), 3) for _ in range(150)), *(draw.randrange(40000) / 20 for _ in range(150))]
    made = [(f"r{i % 7}", i, draw.choice([i * 25.0, i + 0.25, i / 20]), e, f"text {i}") for i, e in enumerate(ends)]
    odd = [("r0", 900, None, 1.0, "x"), ("r0", 901, 1.0, None, "x"), ("r0", 902, 1.0, 2.0, None), ("none", 0, None, None, None)]
    df = spark.createDataFrame(made + odd + made[:3], "recording_id string, index int, start_s double, end_s double, transcript string")
    df.withColumns({"generation_tokens": F.lit(1.0), "latency_ms": F.lit(1), "created_at": F.lit(None).cast("timestamp")}).write.parquet(str(tmp_path / "audio_windows.parquet"))
    want = {r: "\n\n".join(f"[{s:.1f}s-{e:.1f}s] {t}" for k, _, s, e, t in made if k == r) for r in {m[0] for m in made}}
    assert dict(rows(catalogue.literal_transcripts(spark, str(tmp_path)))) == want


def test_sentence_counts_have_all_documents(spark, tmp_path):
    from wrackline.plans import catalogue

    texts = ["One. Two!\x0bThree?\x0b Four", None, "", "No end", "A.\u000b\tB."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert dict(rows(catalogue.sentence_counts(spark, str(tmp_path)))) == {0: 4, 1: None, 2: 1, 3: 1, 4: 2}


def test_continuation_is_the_plain_loop():
    def plain(before, words):
        reach, drop, span, best = min(60, len(before), len(words)), 0, 0, 0.0
        for n in range(2, reach + 1):
            for m in range(max(2, n - 4), min(reach, n + 4) + 1):
                like = SequenceMatcher(None, S._key(before[-n:]), S._key(words[:m])).ratio()
                if like >= 0.72 and (like > best + 0.02 or abs(like - best) <= 0.02 and min(n, m) > span):
                    drop, span, best = m, min(n, m), like
        return words[drop:]

    draw = random.Random(11)
    stock = "and the reef cane lamp tide quay boat fish sail wind rain sand hill road town".split()
    for size in (3, 12, 30, 40, 45, 50):
        for year in ([], ["1987"]):
            before, tail, after = ([draw.choice(words) for _ in range(k)] for k, words in ((30, "aio"), (size, [w[:3] for w in stock] if size < 48 else stock), (30, "uey")))
            tail[size // 2 : size // 2] = year
            assert S.continuation(before + tail, tail + after) == plain(before + tail, tail + after), (size, year)


def test_sequences_in_parts(spark, monkeypatch):
    draw = random.Random(2)
    made = [(k, i, draw.choice([None, None, f"v{i}"]), draw.random() < 0.3) for k in ("a", "b", None) for i in sorted(draw.sample(range(300), 120))]
    df = spark.createDataFrame(made, "k string, i int, v string, h boolean")
    monkeypatch.setattr(S, "PART", 16)
    near = {(r.k, r.i): r for r in S.following(S.preceding(df, "k", "i", "h", "before"), "k", "i", F.col("v"), "after").collect()}
    total = {(r.k, r.i): r.n for r in S.running(df, ["k"], F.floor(F.col("i") / 16), ["i"], F.col("h").cast("int"), "n").collect()}
    for k in ("a", "b", None):
        mine = [m for m in made if m[0] == k]
        for n, (_, i, _, h) in enumerate(mine):
            assert near[k, i].after == next((v for _, _, v, _ in mine[n + 1 :] if v), None)
            assert near[k, i].before == (mine[n - 1][3] if n else None)
            assert total[k, i] == sum(x[3] for x in mine[: n + 1])


def test_following_is_linear(spark):
    # one sequence of 60,000 rows: a frame that is added up anew for each row would take minutes
    import time

    df = spark.range(60_000).select(F.lit("s").alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 9_000 == 8_999, F.col("id")).alias("v"))
    began = time.time()
    want = sum(next((v for v in range(8_999, 60_000, 9_000) if v > i), 0) for i in range(60_000))
    assert S.following(df, "k", "i", F.col("v"), "after").agg(F.sum("after")).first()[0] == want
    assert time.time() - began < 60


def test_chunk_windows(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([4, 4, 3, 20, 1])] + [("z", 0, 0)], "k string, i int, s int")
    assert sorted(rows(S.chunk_windows(df, "k", "i", "s", 10))) == [("k", 0, 11), ("k", 1, 20), ("k", 2, 1)]


def test_near_pairs_against_all(spark):
    draw = random.Random(9)
    hashes = [draw.getrandbits(64) for _ in range(60)]
    for h in hashes[:40]:
        for bits in (1, 3, 4):
            x = h
            for b in draw.sample(range(64), bits):
                x ^= 1 << b
            hashes.append(x)
    made = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)] + [(999, None)]
    got = {tuple(r) for r in D.near_pairs(spark.createDataFrame(made, "id int, hash bigint")).collect()}
    assert got == {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if bin(hashes[i] ^ hashes[j]).count("1") <= 3}


def test_build_and_outcomes(spark):
    from wrackline.operators import extraction as E

    prose = "The council met on Monday in Bridgetown and agreed that the new plan would go ahead at once without further debate"
    text = "\n\n".join(["## Big news", prose + " one.", "## More news", prose + " one.", "## Last news", "Too short to be of any use to anybody at all here."])
    records, counters = E.build(spark.createDataFrame([("e", text), ("f", text)], "source string, text string"), 5, 60, 12)
    assert counters.first().asDict() == {"scanned_files": 2, "extracted_records": 6, "below_minimum_records": 0, "off_domain_records": 0, "exact_duplicates": 3, "near_duplicates": 1, "output_records": 2}
    assert [(r.source, r.ordinal) for r in records.collect()] == [("e", 1), ("e", 2)]

    def convert(path, content):
        if b"bad" in content:
            raise ValueError("unreadable")
        return content.decode()

    files = spark.createDataFrame([("a.pdf", b"some text"), ("b.pdf", b"bad"), ("c.pdf", b"  ")], "path string, content binary")
    assert {r.path: r.error for r in E.converted(files, convert).collect()} == {"a.pdf": None, "b.pdf": "ValueError: unreadable", "c.pdf": "ValueError: no text in it"}
    assert {r.path: (r.duration_s, r.error) for r in E.measured(files, lambda p, c: len(c) - 2).collect()} == {"a.pdf": (7.0, None), "b.pdf": (1.0, None), "c.pdf": (None, "ValueError: a length of 0.0 s")}
    with pytest.raises(Exception, match="unreadable"):
        E.converted(files, convert, fail_fast=True).collect()


def test_probes(spark):
    import json

    from wrackline.operators import probes as O

    good = {"id": "a", "fact_id": "f", "variant": "canonical", "track": "local", "category": "c", "prompt": "Where? ", "choices": ["w", "x", "y", "z"], "answer_index": 1, "source_digests": ["0" * 64], "stability": "s", "exposure": "e"}
    pair = [good, good | {"id": "b", "variant": "paraphrase"}]
    lines = lambda *objects: spark.createDataFrame([("p", i + 1, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(objects)], "shard string, line_no bigint, raw string")
    held = O.loaded(lines(*pair, "  ")).orderBy("id").collect()
    assert [(r.id, r.source_group, r.membership, r.sources) for r in held] == [("a", "a", "unverified", []), ("b", "b", "unverified", [])]
    cases = {
        "not JSON": "{", "not an object": "[1]", "missing: choices": {k: v for k, v in good.items() if k != "choices"}, "needs four choices": good | {"choices": ["a"]}, "choices must be texts": good | {"choices": ["a", "b", "c", " "]}, "answer_index out of range": good | {"answer_index": 4}, "id must be a text": good | {"id": ""},
        "unknown track": good | {"track": "x"}, "sources must be texts": good | {"sources": [1]}, "fact_id must be a text": good | {"fact_id": 5}, "unknown variant": good | {"variant": "x"}, "source_digests must be SHA-256": good | {"source_digests": ["A" * 64]}, "needs source digests": good | {"source_digests": []},
    }
    for why, bad in cases.items():
        assert why in [r.problem for r in O.checked(O.parsed(lines(bad))).collect()], why
        with pytest.raises(Exception, match="p:1: "):
            O.loaded(lines(bad)).count()
    assert {r.problem for r in O.checked(O.parsed(lines(good, good))).collect()} >= {"id stands twice"}
    with pytest.raises(ValueError):
        O.loaded(lines("  "))
    ids = spark.createDataFrame([([1, 2, 3], [1, 2, 9, 4], [0.0, -1.0, -2.0, -4.0]), ([1, 2], [1, 2, 3], [0.0, -1.0, -3.0])], "a array<int>, b array<int>, p array<double>")
    start = O.completion_start(F.col("a"), F.col("b"))
    assert rows(ids.select(start, O.mean_log_probability(F.col("p"), start))) == [(2, -3.0), (2, -3.0)]
    with pytest.raises(Exception, match="no completion tokens"):
        ids.select(O.mean_log_probability(F.col("p"), F.lit(0))).collect()


def test_gates(spark):
    from wrackline.functions import gates as G

    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert [value(G.convolved_length(F.lit(n))) for n in (0, 1, 8, 9, 99, 100, 250)] == [0, 1, 1, 2, 13, 13, 33]
    with pytest.raises(Exception, match="limit is 30"):
        one.select(G.checked_duration(F.lit(31.0), 30)).collect()
    with pytest.raises(Exception, match="did not improve"):
        one.select(G.checked_improvement(F.lit(3.0), F.lit(3.2), 0.1)).collect()
    assert value(G.text_config(F.lit('{"rope_parameters": {"rope_theta": 7}, "num_local_experts": 8}'))).asDict() == {"rope_theta": "7", "rope_scaling": '{"type":"default"}', "num_experts": "8"}
    assert value(G.text_config(F.lit('{"rope_theta": 1, "rope_parameters": {"rope_theta": 7}, "num_experts": 2}')))["rope_theta"] == "1"
    paths = spark.createDataFrame([("optimizer.pt",), ("runs/a/b",), ("rng_state_0",), ("model.bin",), ("x.pth",)], "p string")
    assert [r.p for r in paths.where(G.ignored(F.col("p"), ("optimizer.pt", "runs/", "rng_state*", "*.pth"))).collect()] == ["optimizer.pt", "runs/a/b", "rng_state_0", "x.pth"]


def test_weight_map(spark):
    kind = lambda n: S.weight_kind(n, ("thinker.",), ("talker.",), (), False)
    df = spark.createDataFrame([({"thinker.a": "1", "talker.b": "2", "c": "1"},)], "m map<string, string>")
    assert df.select(S.weight_map(F.col("m"), kind).alias("m")).first()["m"] == {"thinker.a": "1", "c": "1"}
