import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from wrackline.llm import boilerplate, cutting, encoding, leakage, mixing, neardup, packing, scans, toxicity
from wrackline.llm import crosssplit as X
from wrackline.llm import words as W
from wrackline.llm.components import components

WORDS = [f"{a}{b}" for a in ("sun", "sea", "salt", "sand", "wind", "reef", "palm", "rain") for b in ("light", "mark", "stone", "field", "gate", "house", "line", "bird")]


def shingles(text, k):
    w = W.words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def likeness(a, b, k):
    x, y = shingles(a, k), shingles(b, k)
    return len(x & y) / len(x | y) if x and y else 0.0


def collection(seed, n, edits=(0, 2, 4, 8)):
    draw = random.Random(seed)
    texts = []
    while len(texts) < n:
        base = [draw.choice(WORDS) for _ in range(draw.randint(20, 60))]
        for e in edits[: draw.randint(1, len(edits))]:
            w = list(base)
            for _ in range(e):
                at = draw.randrange(len(w))
                w[at : at + 1] = draw.choice([[], [draw.choice(WORDS)], [w[at], draw.choice(WORDS)]])
            texts.append(" ".join(w))
    return texts[:n]


def test_words():
    assert W.words("Fiancée's CAFÉ́ 2nd_x") == ["fiancee", "s", "cafe", "2nd", "x"]
    assert W.words(None) == [] and W.words("  ") == []


def test_grams_against_plain_loops():
    texts = ["a b c d", "", "a b", "b c d e f"]
    value, text, at = W.grams(*W.hashed(texts, W.WordHashes()), 3)
    want = [(t, i) for t, s in enumerate(texts) for i in range(len(s.split()) - 2)]
    assert list(zip(text.tolist(), at.tolist())) == want
    assert value[1] == value[2] and len(set(value.tolist())) == 4


def test_near_duplicates_against_all_pairs(spark):
    texts = collection(1, 150)
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "two words"), (503, "two words"), (505, " " * 40), (506, " " * 40), (507, "Local news"), (508, "Local news"), (504, texts[0]), (None, texts[0]), (3, texts[3])]
    df = spark.createDataFrame(rows, "record_id bigint, content string").withColumn("rep", F.lit("clash")).withColumn("n", F.lit(1))
    members, links = neardup.near_links(df, "record_id", "content", words=3, likeness=0.5)
    got = {tuple(r) for r in neardup.expanded(members, links).collect()}
    known = {i: t for i, t in rows if i is not None and t}
    want = {(a, b) for a, b in itertools.combinations(sorted(known), 2) if likeness(known[a], known[b], 3) >= 0.5}
    assert got == want
    sure = neardup.near_links(df, "record_id", "content", words=3, likeness=0.5, exact=True)
    assert {tuple(r) for r in neardup.expanded(*sure).collect()} == want
    found = neardup.near_groups(df, "record_id", "content", words=3, likeness=0.5)
    groups = {r.id: r for r in found.collect()}
    held = [g for i, g in groups.items() if i is not None and len(W.words(known.get(i, ""))) > 2]
    counts = neardup.counted(found).first()
    assert counts.records == len(groups) and counts.exact_duplicates == sum(g.id != g.rep for g in held)
    assert counts.near_duplicates == len({g.rep for g in held}) - len({g.class_id for g in held}) and counts.remaining == counts.records - counts.exact_duplicates - counts.near_duplicates
    assert set(groups) == {i for i, _ in rows if i is not None}
    for a, b in want:
        assert groups[a].class_id == groups[b].class_id
    assert groups[500].links == 0 and groups[502].class_id == groups[503].class_id == 502


def test_large_cells_are_cut_without_loss(spark):
    texts = collection(2, 90)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    records = neardup.signatures(df, 3)
    got = {tuple(r) for r in neardup.cell_pairs(records.select(F.lit(7).cast("bigint").alias("cell"), "id"), records, 0.5, block=20).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(90), 2) if likeness(texts[a], texts[b], 3) >= 0.5}
    assert want <= got and len(got) < 90 * 89 / 4


def test_tree_bound_loses_nothing():
    draw = np.random.default_rng(5)
    sets = [set(draw.integers(0, 400, draw.integers(5, 80)).tolist()) for _ in range(300)]
    sets += [set(list(s)[:-2]) | {999} for s in sets[:60]]
    sets.sort(key=len)
    maps = np.zeros((len(sets), 128), np.bool_)
    for i, s in enumerate(sets):
        maps[i, [x % 128 for x in s]] = True
    tree = neardup.Tree(np.packbits(maps, axis=1).view(np.uint64), np.array([len(s) for s in sets]))
    got = {(int(a), int(b)) for x, y in tree.pairs(0.5) for a, b in zip(x, y)}
    assert {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])} <= got


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)}


def test_cross_split_against_all_pairs(spark):
    texts = collection(3, 200)
    rows = [(i, ("train", "eval", None)[(i % 5 == 1) + 2 * (i % 17 == 3)] if i % 5 != 1 or i % 17 != 3 else "eval", t) for i, t in enumerate(texts)]
    rows += [(900, "eval", "short text of six words here"), (901, "train", "Short text of six words, here"), (902, "eval", None), (903, "train", ""), rows[6]]
    df = spark.createDataFrame(rows, "rec_id bigint, split string, content string").withColumn("id", F.lit("clash"))
    members, links = X.overlaps(df, "rec_id", "content", "split", words=3, likeness=0.5)
    got = {(r.x, r.y) for r in X.expanded(members, links).collect()}
    known = {i: (s, t) for i, s, t in rows if t and s}
    want = {(a, b) for a in known for b in known if known[a][0] == "eval" and known[b][0] == "train" and likeness(known[a][1], known[b][1], 3) >= 0.5}
    assert got == want and (900, 901) in got
    sure = X.overlaps(df, "rec_id", "content", "split", words=3, likeness=0.5, exact=True)
    assert {(r.x, r.y) for r in X.expanded(*sure).collect()} == want
    assert {r.split for r in X.reported(members, links).collect()} == {"eval"}
    other = X.overlaps(df, "rec_id", "content", "split", sides=("train", "eval"), words=3, likeness=0.5)
    report = X.reported(*other, side="train").collect()
    assert [(r.split, r.overlapping) for r in report] == [("train", len({b for _, b in want}))]
    empty = df.where("false")
    assert X.overlaps(empty, "rec_id", "content", "split")[1].count() == 0


def test_bitset_comes_in_blocks(spark, monkeypatch):
    seeds = spark.range(200_000).select(F.xxhash64("id").alias("seed"))
    place = {(r.seed % 2**64 >> 11) % (1 << 22) for r in seeds.collect()}
    rows, kind = [], type(seeds)

    def counted(real):
        def run(df, *args):
            found = real(df, *args)
            rows.append(len(found))
            return found

        return run

    for name in ("collect", "toPandas", "toArrow"):
        monkeypatch.setattr(kind, name, counted(getattr(kind, name)))
    got = X.bitset(seeds, 200_000)
    assert len(got) * 8 == 1 << 22 and set(np.flatnonzero(np.unpackbits(got, bitorder="little"))) == place
    assert rows and max(rows) <= 16  # not a row for each word
    assert not X.bitset(seeds.limit(0), 0).any()


def test_winnow_keeps_the_least_of_each_window():
    draw = np.random.default_rng(1)
    text = np.sort(draw.integers(0, 5, 60))
    rank = draw.integers(0, 50, 60).astype(np.uint64)
    kept = X.winnow(rank, text, rank, 4)
    for t in set(text.tolist()):
        at = np.flatnonzero(text == t)
        for s in range(max(1, len(at) - 3)):
            window = at[s : s + 4]
            assert kept[window][rank[window] == rank[window].min()].all()


def test_best_fit_and_sequences(spark):
    draw = random.Random(4)
    sizes = [draw.randint(1, 60) for _ in range(300)]
    bins = packing.best_fit(sizes, [1 << (i % 40) for i in range(300)], [0] * 300, 100)
    for b in set(bins):
        inside = [i for i, x in enumerate(bins) if x == b]
        assert sum(sizes[i] for i in inside) <= 100 and len({i % 40 for i in inside}) == len(inside)
    assert len(set(packing.best_fit(sizes, [0] * 300, [0] * 300, 100))) <= -(-sum(sizes) // 100) + 1
    assert packing.best_fit([60, 40, 30], [1, 1, 0], [0, 0, 0], 100) == [0, 1, 0]
    rows = [(i, "train", "s", f"t{i % 50}", None, n) for i, n in enumerate(sizes)] + [(900, "eval", "s", "x", "D", 250), (901, "eval", "s", "x", "d", 40), (902, "eval", "s", "y", None, None), (903, None, "s", "y", None, 0)]
    df = spark.createDataFrame(rows, "rec_id bigint, split string, source string, content string, digest string, tokens int").withColumn("packed_at", F.lit(None).cast("timestamp"))
    got = packing.sequences(df.union(df.limit(9)), 100).collect()
    assert {r.rec_id for r in got} == {r[0] for r in rows}
    assert [(r.start, r.tokens) for r in sorted((r for r in got if r.rec_id == 900), key=lambda r: r.piece)] == [(0, 100), (100, 100), (200, 50)]
    fill = {}
    for r in got:
        if r.sequence:
            fill[r.sequence] = fill.get(r.sequence, 0) + r.tokens
    assert max(fill.values()) <= 100
    assert len({r.sequence for r in got if r.rec_id in (900, 901)}) == 4  # the same digest: never together
    assert {r.rec_id: r.status for r in got if r.rec_id > 901} == {902: "unknown", 903: "empty"}


def test_repeated_lines(spark):
    foot = "All rights reserved - The Bell"
    rows = [(i, "bell", f"Text {i} words\n\n{foot.upper() if i % 2 else foot}\nAsk your agent") for i in range(10)] + [(20, "horn", f"x\n{foot}"), (21, "horn", None), (22, None, "y"), (23, "bell", "")]
    df = spark.createDataFrame(rows + rows[:2], "record_id bigint, source string, content string").withColumn("wording", F.lit(1))
    got = {(r.id, r.line_no) for r in boilerplate.repeated_lines(df, "record_id", "source", "content").collect()}
    assert got == {(i, n) for i in range(10) for n in (3, 4)} | {(i, 1) for i in range(10)}
    block = {r.wording: r.block for r in boilerplate.blocks(df, "record_id", "source", "content").collect()}
    assert block["all rights reserved the bell"] == block["ask your agent"]
    clean = {r.id: r.text for r in boilerplate.without_lines(df, "record_id", "source", "content").collect()}
    assert clean[0] == "" and clean[20] == f"x\n{foot}" and clean[21] is None and len(clean) == 14
    assert boilerplate.repeated_lines(df.where("false"), "record_id", "source", "content").count() == 0


def reference_pieces(start, end, pauses, limit, overlap):
    out, at = [], start
    stops = sorted(round(p * 1000) for p in pauses or [])
    start, end, at = round(start * 1000), round(end * 1000), round(start * 1000)
    while True:
        if end - at <= limit * 1000:
            return [*out, (at / 1000, end / 1000)]
        fits = [p for p in stops if at + overlap * 1000 < p <= at + limit * 1000 and p < end]
        stop = max(fits, default=at + limit * 1000)
        out.append((at / 1000, stop / 1000))
        at = stop - round(overlap * 1000)


def test_cutting_against_plain_loop(spark):
    draw = random.Random(6)
    rows = []
    for i in range(60):
        start, size = round(draw.uniform(0, 50), 3), round(draw.uniform(0.5, 200), 3)
        pauses = [round(start + draw.uniform(-1, size + 1), 2) for _ in range(draw.randint(0, 12))] or None
        rows.append(("r", i, start, round(start + size, 3), 1000.0, pauses))
    rows += [("r", 100, 0.0, None, 40.0, []), ("r", 101, 0.0, 90.0, 31.0, None), ("r", 102, 5.0, 5.0, 9.0, None), ("q", 0, None, 9.0, 9.0, None)]
    df = spark.createDataFrame(rows + rows[:3], "recording_id string, index int, start_s double, end_s double, recording_s double, pauses array<double>").withColumn("created_at", F.lit(None).cast("timestamp"))
    got = {}
    for r in cutting.cut_windows(df).orderBy("recording_id", "index").collect():
        got.setdefault((r.recording_id, r.source_index), []).append((r.start_s, r.end_s))
    for rec, i, start, end, whole, pauses in rows:
        if start is not None and i != 102:
            end = whole if end is None else min(end, whole)
            want = reference_pieces(start, end, pauses, 30, 5)
            assert len(got[rec, i]) == len(want) and np.allclose(got[rec, i], want, atol=1e-5), (i, start, end, pauses)
            assert all(b - a <= 30.0011 for a, b in got[rec, i])
    assert got["r", 102] == [(5.0, 5.0)] and got["q", 0] == [(None, 9.0)]
    over = {(r.recording_id, r["index"]) for r in cutting.overlong(df).collect()}
    assert ("r", 100) in over and ("r", 101) in over and ("r", 102) not in over


def test_leaks(spark):
    draw = random.Random(8)
    prompts = [(f"p{i}", " ".join(draw.choice(WORDS) for _ in range(14))) for i in range(20)] + [("short", "one two three"), ("none", None)]
    texts = []
    for i in range(60):
        body = [draw.choice(WORDS) for _ in range(50)]
        p = prompts[i % 20][1].split()
        n = draw.choice([0, 5, 8, 14])
        body[10:10] = p[:n] if i % 3 else [*p[:4], "changed", *p[5:n]]
        texts.append((i, " ".join(body)))
    df = spark.createDataFrame(texts + [(900, None), (901, ""), texts[1]], "rec_id bigint, content string")
    items = spark.createDataFrame(prompts, "id string, prompt string")
    run = lambda t, k: {tuple(w[i : i + k]) for w in [W.words(t)] for i in range(len(w) - k + 1)}
    want = {(i, p) for i, t in texts for p, q in prompts if q and run(t, 8) & run(q, 8)}
    for most in (2_000_000, 0):
        got = leakage.leaks(df, "rec_id", "content", items, "id", "prompt", most=most).collect()
        assert {(r.id, r.item) for r in got if r.longest >= 8} == want
        assert any(r.longest < 8 and r.differing for r in got)
    assert leakage.leaks(df.where("false"), "rec_id", "content", items, "id", "prompt").count() == 0


def test_encoding_round_trip(spark):
    texts = ["Hello  world\n\n it's 2024 <|endoftext|>", "", None, " ", "é中文 \U0001f600​ x" * 30, "the the the", "a\t\r\n b   "]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(5, "the the the", 1)], "doc_id bigint, text string, ids int")
    got = dict(tuple(r) for r in encoding.encoded(df, "doc_id", "text").collect())
    one = encoding.tokenizer()
    assert got == {i: one.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = dict(tuple(r) for r in encoding.decoded(encoding.encoded(df, "doc_id", "text"), "doc_id").collect())
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_schedule_stays_within_a_block():
    from fractions import Fraction

    weights = [Fraction(n, 20) for n in (9, 6, 4, 1)]
    slots = mixing.schedule(weights, [180, 120, 80, 20])
    done = [0] * 4
    for t, (s, i) in enumerate(slots, 1):
        assert i == done[s]
        done[s] += 1
        assert all(abs(d - t * w) < 1 for d, w in zip(done, weights))


def test_mixing_meets_shares(spark):
    draw = random.Random(9)
    rows = [(i, "abc"[i % 10 > 5] if i % 10 < 9 else "c", draw.randint(1, 90)) for i in range(3000)] + [(9000, "z", 5), (9001, None, 5), (9002, "a", 0)]
    targets = [("a", 0.3, 2), ("b", 0.2, 1), ("c", 0.4, 3), ("gone", 0.1, 2), (None, 0.5, 1)]
    df = spark.createDataFrame(rows, "id bigint, source string, tokens bigint")
    chosen, shares = mixing.mixed(df, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), block=64)
    got = {r.source: r for r in shares.collect()}
    total = sum(r.tokens for r in got.values())
    for s, share in (("a", 0.3), ("b", 0.2), ("c", 0.4)):
        assert abs(got[s].tokens - share / 0.9 * total) <= 200 and got[s].uses <= got[s].records * dict((t[0], t[2]) for t in targets)[s]
    assert got["gone"].tokens == 0
    used = chosen.collect()
    assert len(used) == sum(r.uses for r in got.values()) and len({(r.id, r.repeat) for r in used}) == len(used)


def test_scans():
    frequent = {"reef": 5} | {w: 1000 for w in "the council met on monday and agreed that new plan would go ahead with half finished road mending gang january".split()}
    lex = scans.Lexicon(frequent, {"half-finished": 50}, {}, {"news", "sport"})
    found = lambda t, n=None: [w for *_, w in scans.cut_words(t, n, lex)]
    assert found("the coun-\ncil met") == ["council"] and found("the half-\nfinished road") == [] and found("the coun¬\ncil") == ["council"]
    assert found("the road and coun-", "cil met") == ["council"] and found("agreed with half-", "finished plan") == []
    wrong = lambda t: [b for _, b in scans.misread(t, lex)]
    assert wrong("the councii met on rnonday in janu@ry with h alf the r o a d") == ["council", "monday", "january", "half", "road"]
    assert wrong("The road-mending gang, the half-finished plan: $12,500 on Block 7B") == []
    for text, want in {"The Bell | News | 12.1.1998": (True, False), "THE BELL   Monday, March 6, 1950  Page 3": (True, True), "2  Bell, 22 Aug 1951": (True, True), "NEWS - The Bell\nThe council": (True, False), "The council met on Monday": (False, False), "N E W S - The Be11": (True, False)}.items():
        length, numbered = scans.header_of(text, "bell", {"news", "sport"})
        assert (bool(length), numbered) == want, text
    assert [bool(scans.page_number(t)) for t in ("12", "- 3 -", "Page 12", "PAGE TWO", "[4]", "3 / 16", "I", "Lot", "x", "")] == [True] * 7 + [False] * 3


def test_paragraphs_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(scans, "CHUNK", 4)
    words = "the council met on monday and agreed that new plan would go ahead at once with all members".split()
    lex = scans.Lexicon({w: 1000 for w in words}, {}, {}, set())
    long = "the council met on monday and agreed that the new plan would"
    rows = [("s", 0, "The council met."), ("s", 1, long), ("s", 2, None), ("s", 3, "17"), *[("s", i, str(i)) for i in range(4, 40)], ("s", 40, "go ahead with all mem-"), *[("s", i, "Page 7") for i in range(41, 46)], ("s", 46, "bers at once."), ("s", 47, "The plan."), (None, 3, long), (None, 4, "go ahead.")]
    df = spark.createDataFrame(rows, "source string, idx int, text string").withColumn("is_heading", F.lit(False)).withColumn("scanned_at", F.lit(None).cast("timestamp"))
    got = [(r.source, r.idx, r.text) for r in scans.repaired(df, lex).orderBy("source", "idx").collect()]
    assert got == [(None, 3, long + " go ahead."), ("s", 0, "The council met."), ("s", 1, long + " go ahead with all members at once."), ("s", 47, "The plan.")]
    assert {(r.idx, r.kind) for r in scans.damage(df, lex).collect() if r.kind != "page_number"} == {(40, "hyphen")}
    # the same whatever the size of chunks
    monkeypatch.setattr(scans, "CHUNK", 1024)
    assert [(r.source, r.idx, r.text) for r in scans.repaired(df, lex).orderBy("source", "idx").collect()] == got


def test_headers_of_any_length():
    long = "The Bell | " + "| " * 60 + "News | 12.1.1998 Page 3"
    assert scans.header_of(long, "bell", {"news"}) == (len(long), True)


def test_copies_cost_no_more(spark):
    import time

    began = time.time()
    bins = packing.best_fit([10] * 40_000, [1] * 40_000, [0] * 40_000, 100)
    assert len(set(bins)) == 40_000 and time.time() - began < 20
    draw = random.Random(3)
    sizes, clusters = [draw.randint(1, 60) for _ in range(400)], [1 << draw.randrange(6) if draw.random() < 0.5 else 0 for _ in range(400)]
    bins = packing.best_fit(sizes, clusters, [0] * 400, 100)
    # against the plain search from the tightest bin on
    room, held, want = [], [], [0] * 400
    for i in sorted(range(400), key=lambda i: (-sizes[i], clusters[i], i)):
        fits = sorted((r, b) for b, r in enumerate(room) if r >= sizes[i] and not held[b] & clusters[i] and r > 0)
        if fits:
            b = fits[0][1]
        else:
            b = len(room)
            room.append(100), held.append(0)
        room[b] -= sizes[i]
        held[b] |= clusters[i]
        want[i] = b
    assert bins == want


def test_schedule_repeats(spark):
    from fractions import Fraction

    each = mixing.period({"a": Fraction(1, 3), "b": Fraction(2, 3) - Fraction(1, 10**9), "c": Fraction(1, 10**9)}, 300)
    assert each == {"a": 100, "b": 199, "c": 1}
    records = spark.createDataFrame([(i, "ab"[i % 4 > 0], 10) for i in range(4000)], "id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 1)], "source string, target_share double, max_repeats int")
    import unittest.mock as mock

    with mock.patch.object(mixing, "PERIOD", 20):
        chosen, shares = mixing.mixed(records, targets, block=10)
        slots = sorted((r.slot, r.source) for r in chosen.collect())
    assert [s for s, _ in slots] == list(range(4000)) and {r.source: r.binding for r in shares.collect()} == {"a": True, "b": True}
    done = 0
    for t, (_, source) in enumerate(slots, 1):
        done += source == "a"
        assert abs(done - t / 4) < 1


def test_scans_in_spark(spark):
    body = "The council met on Monday and agreed that the new plan would go ahead."
    rows = [("the-bell_1950-03-06", i, body, False) for i in range(20)]
    rows += [("the-bell_1950-03-06", 20, "THE BELL   Monday, March 6, 1950  Page 3", False), ("the-bell_1950-03-06", 21, "The council met on Mon-\nday and agreed that the n3w plan would go", None), ("the-bell_1950-03-06", 22, "7", False), ("the-bell_1950-03-06", 23, "ahead.", False), ("the-bell_1950-03-06", 24, None, None), ("the-bell_1950-03-06", 25, "", True), (None, 0, body, True)]
    df = spark.createDataFrame(rows + rows[:2], "source string, idx int, text string, is_heading boolean").withColumn("scanned_at", F.lit(None).cast("timestamp"))
    lex = scans.lexicon(df, vectors=False)
    got = {(r.idx, r.kind) for r in scans.damage(df, lex).collect()}
    assert got == {(20, "header"), (20, "page_number"), (21, "hyphen"), (21, "ocr"), (22, "page_number")}
    text = {r.idx: r.text for r in scans.repaired(df, lex).where("source is not null").collect()}
    assert text[21] == body and 20 not in text and 22 not in text and 23 not in text


def test_deleted_lines_are_those_of_the_blocks(spark, monkeypatch):
    rows = [(i, "s", f"Own words {'abcdefgh'[i]}\nHead line\nNext line\nMore of {'abcdefgh'[i]}" + ("\nLone line" if i < 3 else "")) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, source string, text string")
    hits = {(r.id, r.line_no): r.block for r in boilerplate.repeated_lines(df, "id", "source", "text").collect()}
    assert set(hits) == {(i, n) for i in range(8) for n in (2, 3)} | {(i, 5) for i in range(3)}
    block = {r.wording: r.block for r in boilerplate.blocks(df, "id", "source", "text").collect()}
    assert set(block) == {"head line", "next line", "lone line"} and block["head line"] == block["next line"] != block["lone line"]
    assert hits[0, 2] == block["head line"] and hits[0, 5] == block["lone line"]
    # without blocks nothing is deleted
    plain = boilerplate.Graph.blocks
    monkeypatch.setattr(boilerplate.Graph, "blocks", lambda self: plain(self).where("false"))
    assert {r.removed for r in boilerplate.without_lines(df, "id", "source", "text").collect()} == {0}


def test_later_deliveries_of_records_hold(spark):
    rows = [(i, "s", f"old {'abcd'[i]}\nThe foot", 1) for i in range(4)] + [(0, "s", "new text", 2), (1, "s", "old b\nThe foot", 2)]
    df = spark.createDataFrame(rows, "id int, source string, text string, at int")
    assert sorted((r.id, r.line_no) for r in boilerplate.repeated_lines(df, "id", "source", "text", "at").collect()) == [(1, 2), (2, 2), (3, 2)]
    assert {r.id: r.text for r in boilerplate.without_lines(df, "id", "source", "text", "at").collect()} == {0: "new text", 1: "old b", 2: "old c", 3: "old d"}


def test_overlong_windows_are_those_cut(spark, monkeypatch):
    rows = [("r", 0, 0.0, 30.0, 100.0, []), ("r", 1, 0.0, 30.001, 100.0, None), ("r", 2, 0.0, 30.002, 100.0, None), ("r", 3, 5.0, None, 95.0, [12.0, 40.0]), ("r", 4, 0.0, 90.0, 20.0, []), ("r", 5, None, 90.0, 90.0, []), ("r", 6, 0.0, 1800.0, 1800.0, [20.5])]
    df = spark.createDataFrame(rows, "recording_id string, index int, start_s double, end_s double, recording_s double, pauses array<double>").withColumn("created_at", F.lit(None).cast("timestamp"))
    assert sorted(r["index"] for r in cutting.overlong(df).collect()) == [2, 3, 6]
    # nothing is cut, so nothing is found
    monkeypatch.setattr(cutting, "pieces", lambda *a, **k: F.array(F.lit(1)))
    assert cutting.overlong(df).count() == 0


def test_sections_do_not_depend_on_size(spark):
    headers = ["The Bell | News | 12.1.1998"] * 60 + ["The Bell | Ncws | 12.1.1998", "Mondav, June 24, 1955 The Bell"]
    for times in (1, 10):
        rows = [("the-bell_1998", i, t, False) for i, t in enumerate(headers * times)]
        df = spark.createDataFrame(rows, "source string, idx int, text string, is_heading boolean").withColumn("scanned_at", F.lit(None).cast("timestamp"))
        lex = scans.lexicon(df, vectors=False)
        assert lex.sections == {"news"}
        got = {(r.idx % len(headers), r.kind) for r in scans.damage(df, lex).collect()}
        assert got == {(i, "header") for i in range(62)} | {(60, "ocr"), (61, "ocr")}, times
        assert {r.idx for r in scans.damage(df, lex).where("kind = 'ocr'").collect()} == {i for i in range(62 * times) if i % 62 >= 60}
    # all sections, however many, but not what is left of a misread word
    names = [f"{a}{b}sec" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]
    texts = [f"Bell | {n} | 12.1.1998" for n in names for _ in range(5)] + ["NEW5 - The Bell"] * 6
    df = spark.createDataFrame([("the-bell_1998", i, t) for i, t in enumerate(texts)], "source string, idx int, text string")
    assert scans.lexicon(df, vectors=False).sections == set(names)


def test_index_is_exact():
    draw = np.random.default_rng(3)
    idf = draw.uniform(0.1, 5, 80)
    rows = [sorted(set(np.minimum(draw.geometric(0.06, 12) - 1, 79).tolist())) for _ in range(900)]
    index = toxicity.Index(toxicity.Units(np.concatenate(rows), np.array([len(r) for r in rows]), np.zeros(900)), idf)
    dense = np.zeros((900, 80))
    for i, r in enumerate(rows):
        dense[i, r] = idf[r]
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    for query in rows[:60]:
        v = np.zeros(80)
        v[query] = idf[query]
        want = np.sort(dense @ (v / np.linalg.norm(v)))[::-1][:10]
        near, value = index.nearest(np.array(query), 10)
        assert np.allclose(np.sort(value)[::-1], want, atol=1e-5)


def test_toxic_held_out(spark):
    draw = random.Random(11)
    bad = ["You are a worthless {} and everybody knows it", "Shut your mouth, you stinking {}", "Go home, you filthy {}, nobody wants you"]
    fine = ["The court heard that he had written 'you worthless {}' on her gate", "The {} met the coach near the old gate on Monday", "Every {} was painted before the regatta began"]
    names = ["clown", "fool", "coward", "goat", "boat", "liar", "pig", "board"]

    def doc(toxic):
        s = [draw.choice(fine).format(draw.choice(names)) + "." for _ in range(3)]
        if toxic:
            s.insert(1, draw.choice(bad).format(draw.choice(["c-l-o-w-n", "f00l", "cowarddd", "liar"])) + "!")
        return " ".join(s)

    docs = [(i, doc(i % 6 == 0), int(i % 6 == 0)) for i in range(360)]
    df = spark.createDataFrame([(i, t, "s") for i, t, _ in docs] + [(900, None, None), (901, "", "s"), (902, "  ", "s")], "doc_id bigint, text string, source string").withColumn("vote", F.lit(1))
    labels = spark.createDataFrame([(i, b) for i, _, b in docs if i < 240] + [(1, None), (None, 1)], "doc_id bigint, toxic int")
    judge = toxicity.trained(df, "doc_id", "text", labels)
    scores = toxicity.scored(df, "doc_id", "text", judge, ("source",))
    got = {r.id for r in scores.where(F.col("vote") >= toxicity.CUT).collect()}
    want = {i for i, _, b in docs if b}
    held = {i for i in range(240, 360)}
    assert len(got & want & held) >= 0.9 * len(want & held) and len((got - want) & held) <= 2 and not got & {900, 901, 902}
    assert sum(r.documents for r in toxicity.rates(scores, "source").collect()) == 363
