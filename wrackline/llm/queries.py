"""Queries over the tables of TESTDATA.md, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrackline.llm import boilerplate, crosssplit, cutting, encoding, leakage, mixing, neardup, packing, scans, toxicity
from wrackline.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "corpus_records")
    members, links = neardup.near_links(records, "record_id", "content", "extracted_at", words=3, likeness=0.5)
    return neardup.expanded(members, links).toDF("record_id_a", "record_id_b")


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_groups(table(spark, folder, "corpus_records"), "record_id", "content", "extracted_at", words=3, likeness=0.5)


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder).select(F.col("id").alias("record_id"), "class_id", "links", "copies")


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.counted(_groups(spark, folder))


def _cross(spark: SparkSession, folder: str):
    records = table(spark, folder, "validated_records")
    return crosssplit.overlaps(records, "rec_id", "content", "split", "packed_at", keep=("source",), words=3, likeness=0.5)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = crosssplit.expanded(*_cross(spark, folder))
    return rows.select(F.least("x", "y").alias("rec_id_a"), F.greatest("x", "y").alias("rec_id_b"))


def p2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return crosssplit.reported(*_cross(spark, folder), "source")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "corpus_records")
    return boilerplate.repeated_lines(records, "record_id", "source", "content", "extracted_at").select(F.col("id").alias("record_id"), "line_no")


def p4_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.blocks(table(spark, folder, "corpus_records"), "record_id", "source", "content", "extracted_at")


def p4_clean(spark: SparkSession, folder: str) -> DataFrame:
    rows = boilerplate.without_lines(table(spark, folder, "corpus_records"), "record_id", "source", "content", "extracted_at")
    return rows.toDF("record_id", "source", "content", "removed")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return cutting.overlong(table(spark, folder, "audio_windows"))


def p5_windows(spark: SparkSession, folder: str) -> DataFrame:
    return cutting.cut_windows(table(spark, folder, "audio_windows"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "validated_records").where("split = 'train'")
    return leakage.leaks(records, "rec_id", "content", table(spark, folder, "probes"), "id", "prompt")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where("longest >= 8").select(F.col("id").alias("rec_id"), F.col("item").alias("probe_id"))


def p6_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Each probe with its leaks, beside what it says of itself."""
    hits = _leaks(spark, folder)
    about = hits.groupBy("item").agg(F.count(F.lit(1)).alias("near_records"), F.count(F.when(F.col("longest") >= 8, 1)).alias("records"), F.max("longest").alias("longest"))
    probes = table(spark, folder, "probes").dropDuplicates(["id"])
    zero = F.lit(0)
    return probes.join(about, probes["id"] == about["item"], "left").select(
        F.col("id").alias("probe_id"), "membership", F.size(F.coalesce("source_digests", F.array().cast("array<string>"))).alias("named_sources"), F.coalesce("records", zero).alias("records"), F.coalesce("near_records", zero).alias("near_records"), F.coalesce("longest", zero).alias("longest")
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "text_blocks")
    return scans.damage(blocks, scans.lexicon(blocks))


def p7_text(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "text_blocks")
    return scans.repaired(blocks, scans.lexicon(blocks))


def _manifest_length(spark: SparkSession, folder: str) -> int:
    """max_length of the first manifest by run_id; a table of a few rows."""
    return table(spark, folder, "recipe_manifests").agg(F.min_by("max_length", "run_id")).first()[0]


def p3_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.sequences(table(spark, folder, "validated_records"), _manifest_length(spark, folder))


def p3_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.filled(p3_sequences(spark, folder), _manifest_length(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encoded(table(spark, folder, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.decoded(p8_ids(spark, folder), "doc_id")


def _mix(spark: SparkSession, folder: str):
    sized = encoding.token_counts(table(spark, folder, "documents"), "doc_id", "text", ("source",))
    return mixing.mixed(sized.withColumnRenamed("doc_id", "id"), table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def _toxic(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    judge = toxicity.trained(documents, "doc_id", "text", table(spark, folder, "labels"))
    return toxicity.scored(documents, "doc_id", "text", judge, ("source",)).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _toxic(spark, folder).where(F.col("vote") >= toxicity.CUT).select("doc_id")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _toxic(spark, folder)


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rates(_toxic(spark, folder), "source")


_ALL = (p1_found, p1_groups, p1_counts, p2_found, p2_coverage, p3_sequences, p3_fill, p4_found, p4_blocks, p4_clean, p5_found, p5_windows, p6_found, p6_probes, p7_found, p7_text, p8_ids, p8_decoded, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)
QUERIES = {f.__name__: f for f in _ALL}

def _words(column: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({column})), '[\\p{{L}}\\p{{N}}]+')"


def _alike(table: str, key: str, side: str, test: str) -> str:
    return f"""with docs as (select distinct on ({key}) {key} as id, {side} as side, {_words('content')} as w from {table} where content is not null),
sets as (select id, side, unnest(list_distinct([array_to_string(w[i : i + 2], ' ') for i in generate_series(1, len(w) - 2)])) as s from docs where len(w) > 2),
sizes as (select id, count(*) as n from sets group by id),
common as (select a.id as a, b.id as b, count(*) as n from sets a join sets b on a.s = b.s and a.id < b.id and {test} group by all),
pairs as (select a, b from common join sizes x on x.id = a join sizes y on y.id = b where common.n >= 0.5 * (x.n + y.n - common.n)) select a as {key}_a, b as {key}_b from pairs"""


def _groups_sql(last: str) -> str:
    pairs = _alike("corpus_records", "record_id", "''", "true")
    return "with recursive " + pairs.removeprefix("with ").rsplit(" select ", 1)[0] + f""", r as (select distinct record_id as id, content from corpus_records),
reps as (select id, min(id) over (partition by content) as rep, count(*) over (partition by content) - 1 as copies, content from r), edges as (select a, b from pairs union select b, a from pairs),
reach as (select id as a, id as b from r union select reach.a, edges.b from reach join edges on reach.b = edges.a), groups as (select a as id, min(b) as class_id from reach group by a), {last}"""


_LINES = """r as (select distinct record_id, source, content from corpus_records), l as (select record_id, source, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as line_no from r),
w as (select record_id, source, line, line_no, trim(lower(regexp_replace(line, '[^A-Za-z]+', ' ', 'g'))) as wording from l), n as (select source, count(distinct record_id) as n from r group by source),
k as (select w.source, wording from w join n on w.source = n.source where wording <> '' group by w.source, wording, n.n having count(distinct record_id) >= 3 and count(distinct record_id) * 50 >= n.n)"""

ORACLES: dict[str, str] = {
    "p1_found": _alike("corpus_records", "record_id", "''", "true"),
    "p1_groups": _groups_sql("""linked as (select a, count(distinct r.content) as n from edges join r on r.id = edges.b join r o on o.id = edges.a where o.content <> r.content group by a)
select reps.id as record_id, case when content is null then rep when copies > 0 then least(class_id, rep) else class_id end as class_id, coalesce(n, 0) as links, copies from reps join groups using (id) left join linked on linked.a = reps.id"""),
    "p1_counts": _groups_sql("""g as (select reps.*, class_id, id in (select id from sizes) as has from reps join groups using (id))
select count(*) as records, count(*) filter (has and id <> rep) as exact_duplicates, count(*) filter (has and id = rep and id <> class_id) as near_duplicates, count(*) filter (not has or id = class_id) as remaining from g"""),
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p2_found": _alike("validated_records", "rec_id", "split", "a.side <> b.side and a.side in ('train', 'eval') and b.side in ('train', 'eval')"),
    "p4_found": f"with {_LINES} select record_id, line_no::int as line_no from w join k on w.source = k.source and w.wording = k.wording",
    "p4_clean": f"""with {_LINES}, m as (select w.*, k.wording is not null as gone from w left join k on w.source = k.source and w.wording = k.wording),
c as (select record_id, count(*) filter (gone) as removed, coalesce(string_agg(line, chr(10) order by line_no) filter (not gone), '') as rest from m group by record_id)
select r.record_id, r.source, case when coalesce(removed, 0) = 0 then content else regexp_replace(regexp_replace(rest, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') end as content, coalesce(removed, 0)::int as removed from r left join c using (record_id)""",
    "p5_windows": """with recursive w as (select recording_id, index, start_s, case when end_s is null then recording_s else least(end_s, recording_s) end as e, pauses from (select *, row_number() over (partition by recording_id, index order by created_at desc nulls last, start_s nulls first, end_s nulls first, recording_s nulls first, pauses nulls first) as nth from audio_windows) where nth = 1),
t as (select *, ceil((e - start_s) / 0.001 - 1e-6)::int as len, list_transform(coalesce(pauses, []), lambda p: round((p - start_s) / 0.001)::int) as stops from w where e - start_s > 30.001),
r as (select recording_id, index, start_s, e, len, stops, 0 as piece, 0 as at_, case when len <= 30000 then len else coalesce(list_max(list_filter(stops, lambda p: p > 5000 and p <= 30000 and p < len)), 30000) end as stop from t
union all select recording_id, index, start_s, e, len, stops, piece + 1, stop - 5000, case when len - stop + 5000 <= 30000 then len else coalesce(list_max(list_filter(stops, lambda p: p > stop and p <= stop + 25000 and p < len)), stop + 25000) end from r where stop < len),
p as (select recording_id, index as source_index, piece, case when piece = 0 then start_s else round(start_s + at_ * 0.001, 6) end as start_s, case when stop = len then e else round(start_s + stop * 0.001, 6) end as end_s from r
union all select recording_id, index, 0, start_s, e from w where coalesce(e - start_s <= 30.001, true))
select recording_id, source_index, piece, (row_number() over (partition by recording_id order by source_index, piece) - 1)::int as index, start_s, end_s from p""",
    "p5_found": "select distinct recording_id, index from audio_windows where (case when end_s is null then recording_s else least(end_s, recording_s) end) - start_s > 30.001",
    "p6_found": f"""with d as (select distinct rec_id, {_words('content')} as w from validated_records where split = 'train' and content is not null), p as (select id, {_words('prompt')} as w from probes),
g as (select distinct rec_id, unnest([array_to_string(w[i : i + 7], ' ') for i in generate_series(1, len(w) - 7)]) as g from d where len(w) > 7), h as (select distinct id, unnest([array_to_string(w[i : i + 7], ' ') for i in generate_series(1, len(w) - 7)]) as g from p where len(w) > 7)
select distinct rec_id, id as probe_id from g join h using (g)""",
}
