"""Queries of the core operators over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrackline.functions import patterns as P
from wrackline.functions import predicates as K
from wrackline.functions import text as T
from wrackline.functions import gates as G
from wrackline.operators import blocks as B
from wrackline.operators import checkpoints as H
from wrackline.operators import compare as C
from wrackline.operators import dedup as D
from wrackline.operators import extraction as E
from wrackline.operators import prepare as R
from wrackline.operators import probes as O
from wrackline.operators import sequences as S
from wrackline.sources import files as L
from wrackline.sources import state as Z
from wrackline.sources.tables import table
from wrackline.streaming.metering import metering
from wrackline.streaming.sync import sync

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def q(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def any_sql(column: str, patterns: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"regexp_matches({column}, {q(p)})" for p in patterns) + ")"


COUNT = "len(regexp_extract_all({0}, " + q(P.WORD) + "))"
def canon(column: str) -> str:
    return f"lower(trim(regexp_replace({column}, {q(P.SPACE)}, ' ', 'g')))"


#: What furniture and captions look like, as literals of their own beside those that the code uses.
NOISE = any_sql("text", (
    r"^<!--.*-->$", r"(?i)^.*\bEstablished October 1895\b.*$", r"(?i)^\$[0-9]+(\.[0-9]{2})?\s+VAT Inclusive$", r"(?i)^Page\s+[0-9]+$", r"^.*\b[0-9]{1,2}:[0-9]{2}$", r"(?i)^RUNOVER\b.*$", r"(?i)^\(?Cont['’]?d\b.*(page\s+[0-9]+|next page).*\)?$",
    r"(?i)^.{1,50}\b(from|on)\s+(Front\s+)?Page\s+[0-9]+$", r"(?i)^\(?See .*\bPage\s+[0-9]+.*\)?$", r"(?i)^(ABOVE|BELOW|RIGHT|AT RIGHT|BELOW RIGHT)\b.*", r"^\((DB|JB)\)$", r"(?i)^(SCAN ME|SUBSCRIBE NOW\b.*|SEE MORE\b.*|VISIT US AT\b.*)$", r"(?i)^(Telephone|Contact|Email|Website):\s*.*$", r"(?i)^(https?://|www\.)\S+",
))
CAPTION = any_sql("text", (r"(?i)^\(?(From left|From right|Pictured|Photo)\b", r"(?i)\(([^)]*/)?(BGIS|AP|Reuters|Photo[^)]*|Picture[^)]*)\)\s*$", r"(?i)\b(photo|picture)\s+(by|courtesy of)\b", r"(?i)\bPictured (here|from left|from right)\b"))
CAPTION = f"({CAPTION} or (words <= 45 and regexp_matches(text, '(?i)\\b(pose|poses|presents|presented|presenting|accept|accepts|greeting|looking on|helping)\\b') and not contains(text, '\"')))"
CORRUPT = f"(words >= 12 and len(list_filter(regexp_extract_all(text, {q(P.WORD)}), lambda w: length(w) = 1)) * 100 > words * 15)"
PROSE = f"(words >= {{0}} and regexp_matches(text, '[a-z]{{{{3}}}}') and not {CORRUPT})"
USEFUL = f"(not regexp_matches(text, {q(P.BYLINE)}) and not regexp_matches(text, {q(P.FIXTURE)}) and words between 1 and 24)"
LINES = f"""raw as (select doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) as text, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) - 1 as idx from documents),
lines as (select doc_id, idx, text, {COUNT.format('text')} as words from raw where text <> '')"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)).alias("idx", "text"))
    return rows.where("text <> ''")


@query(f"select doc_id, {COUNT.format('text')}::bigint as words from documents")
def word_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("words"))


@query(f"select doc_id, sha256({canon('text')}) as key from documents")
def canonical_keys(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.sha256(T.canonical(F.col("text"))).alias("key"))


@query("select rec_id, lower(digest) = sha256(trim(content, ' ' || chr(9) || chr(10) || chr(13))) as agrees from (select distinct rec_id, digest, content from validated_records)")
def digest_check(spark, folder):
    rows = table(spark, folder, "validated_records").select("rec_id", "digest", "content").distinct()
    return rows.select("rec_id", (F.lower("digest") == T.sha256(F.trim(F.col("content"), F.lit(" \t\n\r")))).alias("agrees"))


@query(f"""with {LINES} select doc_id, count(*) as lines, count(*) filter ({NOISE}) as noise, count(*) filter ({CAPTION}) as captions, count(*) filter ({CORRUPT}) as corrupt,
count(*) filter ({PROSE.format(8)}) as prose, count(*) filter ({USEFUL}) as headings from lines group by doc_id""")
def line_kinds(spark, folder):
    text = F.col("text")
    tests = {"noise": K.is_noise(text), "captions": K.is_caption(text), "corrupt": K.is_corrupt(text), "prose": K.is_prose(text), "headings": K.is_useful_heading(text)}
    return _lines(spark, folder).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), *[F.count_if(t).alias(n) for n, t in tests.items()])


CAPITAL = f"len(list_filter(regexp_extract_all(text, {q(P.WORD)}), lambda w: regexp_matches(w[1:1], '[A-Z]')))"
SHOUTED = f"len(list_filter(regexp_extract_all(text, {q(P.WORD)}), lambda w: length(w) > 1 and regexp_matches(w, '[A-Z]') and not regexp_matches(w, '[a-z]'))) > 0"
BLOCKS = f"""{LINES},
marked as (select *, {NOISE} or {CAPTION} as gone from lines),
ahead as (select *, first_value(case when not gone then text end ignore nulls) over (partition by doc_id order by idx rows between 1 following and unbounded following) as following from marked),
looks as (select *, words between 1 and 14 and length(text) <= 160 and not regexp_matches(text, '[.?!;:]\\z') and not regexp_matches(text, '^["''(]') and not gone and {USEFUL}
  and ((regexp_matches(text, '[A-Z]') and not regexp_matches(text, '[a-z]')) or {SHOUTED} or {CAPITAL} * 4 >= words) as fits from ahead),
nexts as (select a.* exclude (text, words), a.text as own, a.words as own_words, a.following as text, {COUNT.format('a.following')} as words from looks a),
kinds as (select doc_id, idx, case when gone then null when fits and coalesce({PROSE.format(12)}, false) then 'heading' else 'other' end as kind, own as text, own_words as words from nexts),
blocks as (select doc_id, idx, text, kind = 'heading' as is_heading from kinds where kind = 'heading' or (kind = 'other' and not regexp_matches(text, {q(P.BYLINE)}) and {PROSE.format(8)}))"""


def _blocks(spark, folder):
    rows = _lines(spark, folder).select(F.col("doc_id").alias("source"), "idx", "text", F.lit(False).alias("explicit"))
    return B.blocks(rows)


@query(f"with {BLOCKS} select doc_id, idx, is_heading from blocks")
def block_kinds(spark, folder):
    return _blocks(spark, folder).select(F.col("source").alias("doc_id"), "idx", "is_heading")


@query(f"""with {BLOCKS}, runs as (select *, case when is_heading and not coalesce(lag(is_heading) over (partition by doc_id order by idx), true) then 1 else 0 end as begins from blocks),
numbered as (select *, sum(begins) over (partition by doc_id order by idx) as article from runs)
select doc_id, article::int as article, count(*) as blocks from numbered group by all having bool_or(not is_heading)""")
def article_segments(spark, folder):
    return B.articles(_blocks(spark, folder)).groupBy(F.col("source").alias("doc_id"), "article").agg(F.count(F.lit(1)).alias("blocks"))


@query()
def article_chunks(spark, folder):
    return B.chunks(_blocks(spark, folder).withColumn("source", F.col("source").cast("string")), 20, 80)


@query("select doc_id, len(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)))::bigint as sentences from documents")
def sentence_counts(spark, folder):
    count = F.when(F.col("text").isNotNull(), F.size(T.sentences(F.col("text"))))
    return table(spark, folder, "documents").select("doc_id", count.cast("bigint").alias("sentences"))


#: The names as literals of their own, beside those that the code uses.
LOCAL_SQL = r"'(?i)\b(Barbados|Barbadian|Barbadians|Bajan|Bridgetown|CARICOM|Caribbean|Christ Church|(Saint|St\.) (Michael|Philip|Peter|James|Lucy|George|Thomas|Andrew|Joseph|John)|UWI|Cave Hill)\b'"
FOREIGN_SQL = r"'(?i)(\b(Israeli?|Tunisian?|Ukraine|Ukrainian|United States|Washington|New York|London|European Union|Virgin Galactic)\b|\((AP|Reuters)\)\s*$)'"


@query(f"select distinct record_id, not regexp_matches(content, {LOCAL_SQL}) and regexp_matches(content, {FOREIGN_SQL}) as off_domain, {COUNT.format('content')} < 80 as short from corpus_records where content is not null")
def record_filters(spark, folder):
    rows = table(spark, folder, "corpus_records").where("content is not null")
    return rows.select("record_id", K.is_off_domain(F.col("content")).alias("off_domain"), (T.word_count(F.col("content")) < 80).alias("short")).distinct()


def _records(spark, folder):
    return table(spark, folder, "corpus_records").where("content is not null").select("source", "ordinal", "content").distinct()


@query(f"""select source, ordinal from (select source, ordinal, row_number() over (partition by {canon('content')} order by length(content) desc, source, ordinal) as n
from (select distinct source, ordinal, content from corpus_records where content is not null)) where n = 1""")
def exact_dedup(spark, folder):
    return D.longest_of_copies(_records(spark, folder)).select("source", "ordinal")


@query()
def near_dedup(spark, folder):
    return D.deduplicated(_records(spark, folder))


def _hash_sql(rows: str, key: str, text: str) -> str:
    """CTEs that end in `hashes` (key, hash): the votes of `simhash_md5` on a table's texts."""
    return f"""w as (select {key}, regexp_extract_all(lower({text}), {q(P.WORD)}) as w from {rows} where {text} is not null), p as (select {key}, list_distinct([array_to_string(w[i : i + 4], ' ') for i in generate_series(1, greatest(len(w) - 4, 1))]) as p from w),
h as (select {key}, len(p) as n, unnest([('0x' || substr(md5(x), 17, 16))::ubigint for x in p]) as h from p), b as (select {key}, n, b, count(*) filter ((h >> b::ubigint) & 1 = 1) as c from h, generate_series(0, 63) g(b) group by all),
hashes as (select {key}, (sum(case when b < 63 and c * 2 >= n then (1::hugeint << b::int) else 0 end) - max(case when b = 63 and c * 2 >= n then 9223372036854775808::hugeint else 0 end))::bigint as hash from b group by {key})"""


def _greedy_sql(base: str) -> str:
    """CTEs that end in `x` (source, ordinal, content, r: rank), the longest of copies in `base`, and `last` (gone: ranks that a kept one before is near to)."""
    return f"""x as (select source, ordinal, content, row_number() over (order by length(content) desc, source, ordinal) as r from (select source, ordinal, content, row_number() over (partition by {canon('content')} order by length(content) desc, source, ordinal) as n from {base}) where n = 1),
{_hash_sql('x', 'r', 'content')}, near as (select b.r, list(a.r) as before from hashes a join hashes b on a.r < b.r and bit_count(xor(a.hash, b.hash)) <= 3 group by b.r),
steps as (select 0::bigint as r, []::bigint[] as gone union all select steps.r + 1, case when before is not null and len(list_filter(before, lambda q: not list_contains(gone, q))) > 0 then list_append(gone, steps.r + 1) else gone end from steps left join near on near.r = steps.r + 1 where steps.r < (select max(r) from x)),
last as (select gone from steps order by r desc limit 1)"""


@query(f"with recursive base as (select distinct source, ordinal, content from corpus_records where content is not null), {_greedy_sql('base')} select source, ordinal from x, last where not list_contains(gone, r)")
def near_dedup_md5(spark, folder):
    return D.deduplicated(_records(spark, folder), hashing=T.simhash_md5).select("source", "ordinal")


@query()
def simhashes(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.simhash(F.col("text")).alias("hash"))


@query(f"with {_hash_sql('documents', 'doc_id', 'text')} select doc_id, hash from hashes")
def simhashes_md5(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", T.simhash_md5(F.col("text")).alias("hash"))


@query(f"""with recursive every as (select distinct source, ordinal, content from corpus_records where content is not null), marked as (select *, {COUNT.format('content')} < 80 as short, not regexp_matches(content, {LOCAL_SQL}) and regexp_matches(content, {FOREIGN_SQL}) as off from every),
base as (select source, ordinal, content from marked where not short and not off), {_greedy_sql('base')}
select (select count(distinct source) from every) as scanned_files, (select count(*) from every) as extracted_records, (select count(*) from marked where short) as below_minimum_records, (select count(*) from marked where not short and off) as off_domain_records, (select count(*) from base) - (select count(*) from x) as exact_duplicates,
len(gone)::bigint as near_duplicates, (select count(*) from x) - len(gone) as output_records from last""")
def build_summary_now(spark, folder):
    """The counters that a build reports, on the corpus records, near copies by MD5 votes."""
    rows = _records(spark, folder)
    scanned = rows.agg(F.count_distinct("source").alias("scanned_files"))
    return scanned.crossJoin(F.broadcast(E.filtered(rows, hashing=T.simhash_md5)[1]))  # one row each


@query()
def corpus_build(spark, folder):
    """A whole build: documents as editions of one line a block, to the records that stay."""
    editions = table(spark, folder, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("source"), F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    return E.build(editions, 20, 200, 40, "\n")[0].select("source", "ordinal", F.sha2("content", 256).alias("key"))


VALID = "records as (select distinct shard, line_no, content, sha256(trim(content)) as digest, length(content) as tokens from validated_records where trim(content) <> '')"
FIRST = f"with {VALID}, firsts as (select * from (select *, row_number() over (partition by digest order by shard, line_no) as n from records) where n = 1)"
KEPT = FIRST + ", kept as (select * from firsts where tokens between 128 and 4096), k as (select round_even(count(*) * 0.01, 0)::int as k from kept)"
SPLIT = KEPT + ", ranked as (select *, row_number() over (order by substr(digest, 1, 8), tokens, shard, line_no) as r from kept), split as (select digest, shard, line_no, tokens, case when r <= k then 'eval' else 'train' end as split from ranked, k)"


def _valid(spark, folder):
    rows = table(spark, folder, "validated_records").where("trim(content) <> ''").select("shard", "line_no", "content").distinct()
    return _digested(rows)


def _digested(rows: DataFrame) -> DataFrame:
    return rows.select("shard", "line_no", "content", T.sha256(F.trim("content")).alias("digest"), F.length("content").alias("tokens"))


@query(FIRST + " select digest, shard, line_no, case when tokens < 128 then 'below' when tokens > 4096 then 'above' else 'kept' end as status from firsts")
def sha_dedup_window(spark, folder):
    return R.windowed(_valid(spark, folder)).select("digest", "shard", "line_no", "status")


@query(SPLIT + " select digest, shard, line_no, split from split")
def train_eval_split(spark, folder):
    kept = R.windowed(_valid(spark, folder)).where("status = 'kept'")
    return R.with_split(kept).select("digest", "shard", "line_no", "split")


@query(SPLIT + """ select (select count(*) from (select distinct shard, line_no, content from validated_records)) as total_records, (select count(*) from records) as valid_records, (select count(*) from records) - (select count(*) from firsts) as deduplicated,
(select count(*) from firsts where tokens < 128) as below_min_tokens, (select count(*) from firsts where tokens > 4096) as above_max_tokens,
count(*) filter (split = 'train') as train_records, count(*) filter (split = 'eval') as eval_records, coalesce(sum(tokens) filter (split = 'train'), 0)::bigint as train_tokens, coalesce(sum(tokens) filter (split = 'eval'), 0)::bigint as eval_tokens from split""")
def prepare_summary_now(spark, folder):
    every = table(spark, folder, "validated_records").select("shard", "line_no", "content").distinct()
    seen = R.windowed(_valid(spark, folder))
    return R.summary(every, seen, R.with_split(seen.where("status = 'kept'")), F.coalesce(F.trim("content") != "", F.lit(False)))


def _lines_of(rows: DataFrame) -> DataFrame:
    """Records as JSON lines, those without a split with another role."""
    message = F.struct(F.when(F.col("split").isNull(), "user").otherwise("assistant").alias("role"), "content")
    return rows.select("shard", "line_no", F.to_json(F.struct(F.array(message).alias("messages"))).alias("raw"))


RAW = "raw as (select distinct shard, line_no, case when split is null then 'role is not assistant' when content is null then 'content is not text' when regexp_matches(content, '^\\s*\\z') then 'content is blank' end as reason, content from validated_records)"


@query(f"with {RAW} select shard, line_no, reason, case when reason is null then sha256(regexp_replace(content, '^\\s+|\\s+\\z', '', 'g')) end as digest from raw")
def record_lines(spark, folder):
    """Records as JSON lines, validated, the bad ones with their reason."""
    rows = table(spark, folder, "validated_records").select("shard", "line_no", "split", "content").distinct()
    found = R.validated(_lines_of(rows), quarantine=True)
    return found.select("shard", "line_no", "reason", F.when(F.col("reason").isNull(), F.col("digest")).alias("digest")).distinct()


@query(f"with {RAW} select shard, line_no, content as text from raw")
def first_messages(spark, folder):
    rows = table(spark, folder, "validated_records").select("shard", "line_no", "split", "content").distinct()
    return L.first_messages(_lines_of(rows)).distinct()


@query("select id, case when track = 'control' then 'control' when count(distinct w) = 1 then any_value(w) else 'mixed' end as membership from (select p.id, p.track, case when d is null then null when d in (select digest from validated_records where split = 'train' and digest is not null) then 'train' when d in (select digest from validated_records where split = 'eval' and digest is not null) then 'eval' else 'absent' end as w from (select id, track, unnest(case when len(source_digests) = 0 or source_digests is null then [null] else source_digests end) as d from probes) p) group by id, track")
def digest_membership(spark, folder):
    records = table(spark, folder, "validated_records").where("digest is not null")
    return C.membership(table(spark, folder, "probes"), records.where("split = 'train'"), records.where("split = 'eval'"))


def _probe_lines(spark, folder):
    probes = table(spark, folder, "probes").drop("membership")
    return probes.select(F.lit("probes").alias("shard"), F.row_number().over(Window.orderBy("id")).cast("bigint").alias("line_no"), F.to_json(F.struct(*probes.columns)).alias("raw"))


@query("""with p as (select *, case
when id is null or fact_id is null or variant is null or track is null or category is null or prompt is null or choices is null or answer_index is null or source_digests is null or stability is null or exposure is null then 'missing'
when len(choices) <> 4 then 'needs four choices' when len(list_filter(choices, lambda c: c is null or trim(c) = '')) > 0 then 'choices must be texts' when answer_index not between 0 and 3 then 'answer_index out of range' when id = '' then 'id must be a text'
when row_number() over (partition by id) > 1 then 'id stands twice' when track not in ('local', 'rare_local', 'control') then 'unknown track' when len(list_filter(sources, lambda x: x is null)) > 0 then 'sources must be texts' when fact_id = '' then 'fact_id must be a text'
when variant not in ('canonical', 'paraphrase') then 'unknown variant' when len(list_filter(source_digests, lambda d: d is null or not regexp_matches(d, '^[0-9a-f]{64}\\z'))) > 0 then 'source_digests must be SHA-256' when track <> 'control' and len(source_digests) = 0 then 'needs source digests' end as own,
count(*) over (partition by fact_id) as n, min(variant) over (partition by fact_id) as a, max(variant) over (partition by fact_id) as b from probes)
select id, coalesce(own, case when n <> 2 or a = b then 'fact needs both variants' end) as problem from p""")
def probe_checks(spark, folder):
    rows = O.checked(O.parsed(_probe_lines(spark, folder)))
    return rows.select("id", F.when(F.col("problem").startswith("missing"), "missing").otherwise(F.col("problem")).alias("problem"))


@query("select id, n::int as n, text from (select distinct id, unnest(generate_series(0, len(choices) - 1)) as n, unnest(list_transform(choices, lambda c: rtrim(prompt, ' ' || chr(9) || chr(10)) || ' ' || c)) as text from probes)")
def probe_completions(spark, folder):
    rows = table(spark, folder, "probes").select("id", F.posexplode(O.completions(F.col("prompt"), F.col("choices"))).alias("n", "text"))
    return rows.distinct()


IDS = "ids as (select vec_id, list_transform(embedding[1:8], lambda x: round(x * 4)::int) as a, list_transform(embedding[2:9], lambda x: round(x * 4)::int) as b, list_transform(embedding[1:8], lambda x: x::double) as p from embeddings)"
START = "(coalesce(list_position(list_transform(generate_series(1, 8), lambda i: a[i] = b[i]), false) - 1, 8))::int"


@query(f"with {IDS}, s as (select *, {START} as start from ids) select vec_id, start, case when start between 1 and 7 then round(list_avg(p[start + 1:]), 9) end as score from s")
def completion_scores(spark, folder):
    """Where two token sequences part, and the mean log-probability from there on."""
    ids = lambda at: F.transform(F.slice("embedding", at, 8), lambda x: F.round(x * 4).cast("int"))
    rows = table(spark, folder, "embeddings").select("vec_id", O.completion_start(ids(1), ids(2)).alias("start"), F.slice("embedding", 1, 8).cast("array<double>").alias("p"))
    score = F.when(F.col("start").between(1, 7), O.mean_log_probability(F.col("p"), F.col("start")))
    return rows.select("vec_id", "start", F.round(score, 9).alias("score"))


TRACKS = "['local', 'rare_local', 'control']"
SCORED = f"""scored as (select vec_id as probe_id, {TRACKS}[vec_id % 3 + 1] as track, 'c' || label as category, 'g' || (vec_id % 7) as source_group, 'f' || (vec_id // 6 * 3 + vec_id % 3) as fact_id, 'e' || (vec_id % 5) as exposure, 'm' || (vec_id % 4) as membership, (label % 4)::int as a,
list_transform(embedding[1:4], lambda x: x::double) as b, list_transform(embedding[5:8], lambda x: x::double) as d from embeddings),
pairs as (select probe_id, track, category, exposure, membership, source_group, fact_id, list_position(b, list_max(b)) - 1 = a as base_correct, list_position(d, list_max(d)) - 1 = a as adapter_correct,
b[a + 1] - list_max(list_filter(b, lambda x, i: i <> a + 1)) as base_margin, d[a + 1] - list_max(list_filter(d, lambda x, i: i <> a + 1)) as adapter_margin from scored), deltas as (select *, adapter_margin - base_margin as delta from pairs)"""


def _runs(spark, folder):
    v = table(spark, folder, "embeddings")
    track = F.get(F.array(*[F.lit(t) for t in ("local", "rare_local", "control")]), F.col("vec_id") % 3)
    fact = F.concat(F.lit("f"), (F.floor(F.col("vec_id") / 6) * 3 + F.col("vec_id") % 3).cast("string"))
    dims = v.select(F.col("vec_id").alias("probe_id"), track.alias("track"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("category"), F.concat(F.lit("g"), (F.col("vec_id") % 7).cast("string")).alias("source_group"), fact.alias("fact_id"), F.concat(F.lit("e"), (F.col("vec_id") % 5).cast("string")).alias("exposure"), F.concat(F.lit("m"), (F.col("vec_id") % 4).cast("string")).alias("membership"), (F.col("label") % 4).cast("int").alias("answer_index"), "embedding")
    run = lambda at: C.outcomes(dims.withColumn("scores", F.slice("embedding", at, 4).cast("array<double>")))
    return C.paired(run(1), run(5), ("track", "category", "exposure", "membership", "source_group", "fact_id"))


@query(f"with {SCORED} select probe_id, base_correct, adapter_correct, round(delta, 9) as delta from deltas")
def choice_outcomes(spark, folder):
    return _runs(spark, folder).select("probe_id", "base_correct", "adapter_correct", F.round("delta", 9).alias("delta"))


@query(f"""with {SCORED} select case when grouping(track) = 0 then 'track' when grouping(category) = 0 then 'category' when grouping(exposure) = 0 then 'exposure' when grouping(membership) = 0 then 'membership' else 'overall' end as dimension, coalesce(track, category, exposure, membership) as value, count(*) as n, round(avg(base_correct::int), 9) as base_accuracy,
round(avg(adapter_correct::int), 9) as adapter_accuracy, round(avg(delta), 9) as margin_delta, count(*) filter (delta > 1e-9) as wins, count(*) filter (abs(delta) <= 1e-9) as ties, count(*) filter (delta < -1e-9) as losses from deltas group by grouping sets ((), (track), (category), (exposure), (membership))""")
def grouped_comparison(spark, folder):
    rows = C.grouped(_runs(spark, folder), ("track", "category", "exposure", "membership"))
    return rows.select("dimension", "value", "n", *[F.round(c, 9).alias(c) for c in ("base_accuracy", "adapter_accuracy", "margin_delta")], "wins", "ties", "losses")


@query(f"""with {SCORED} select fact_id as family, min(track) as track, bool_and(base_correct) as base_all, bool_and(adapter_correct) as adapter_all, round(min(base_margin), 9) as base_least, round(min(adapter_margin), 9) as adapter_least,
case when not bool_and(base_correct) and bool_and(adapter_correct) then 'acquired' when bool_and(base_correct) and not bool_and(adapter_correct) then 'regressed' else 'same' end as change from deltas group by fact_id""")
def family_comparison(spark, folder):
    return C.families(_runs(spark, folder)).withColumn("base_least", F.round("base_least", 9)).withColumn("adapter_least", F.round("adapter_least", 9))


@query(f"""with {SCORED}, one as (select coalesce(avg(delta) filter (track in ('local', 'rare_local')), 0) as l, coalesce(avg(delta) filter (track = 'control'), 0) as c from deltas), m as (select avg(m) as m from (select avg(delta) as m from deltas where track <> 'control' group by source_group))
select round(l, 9) as local_delta, round(c, 9) as control_delta, round(l - c, 9) as adjusted_delta, round(coalesce(m, 0), 9) as source_macro_delta from one, m""")
def contrast_deltas(spark, folder):
    rows = C.contrasts(_runs(spark, folder))
    return rows.select(*[F.round(c, 9).alias(c) for c in rows.columns])


@query(f"with {SCORED} select probe_id, track, round(delta, 9) as delta from deltas where delta < 0")
def regressed_probes(spark, folder):
    return _runs(spark, folder).where("delta < 0").select("probe_id", "track", F.round("delta", 9).alias("delta"))


@query(f"""with {SCORED}, t as (select unnest([track, 'overall']) as track, delta, base_correct, adapter_correct, base_margin, adapter_margin from deltas), names as (select unnest(['local', 'rare_local', 'control', 'none', 'overall']) as track)
select track, count(delta) as n, coalesce(round(avg(base_correct::int), 9), 0) as base_accuracy, coalesce(round(avg(adapter_margin), 9), 0) as adapter_margin, coalesce(round(avg(delta), 9), 0) as margin_delta, count(*) filter (delta > 1e-9) as wins, count(*) filter (delta < -1e-9) as losses from names left join t using (track) group by track""")
def track_summaries(spark, folder):
    rows = C.track_summary(_runs(spark, folder), ("local", "rare_local", "control", "none"))
    return rows.select("track", "n", *[F.round(c, 9).alias(c) for c in ("base_accuracy", "adapter_margin", "margin_delta")], "wins", "losses")


def _results(spark, folder):
    return _runs(spark, folder).select("probe_id", "track", "category", F.col("base_correct").alias("correct"))


@query(f"""with {SCORED}, names as (select unnest(['local', 'rare_local', 'control', 'none', 'overall']) as track), t as (select unnest([track, 'overall']) as track, base_correct as c from deltas)
select track, count(c) as n, count(*) filter (c) as right, case when count(c) > 0 then round(avg(c::int), 9) end as accuracy from names left join t using (track) group by track""".replace(" as right,", ' as "right",'))
def track_accuracies(spark, folder):
    rows = C.track_accuracy(_results(spark, folder), ("local", "rare_local", "control", "none"))
    return rows.withColumn("accuracy", F.round("accuracy", 9))


@query(f"with {SCORED} select track || '::' || category as name, count(*) as n from deltas group by all")
def category_counts(spark, folder):
    return C.category_counts(_results(spark, folder))


FAMILIES = f"{SCORED}, families as (select fact_id, min(track) as track, bool_and(base_correct) as b, bool_and(adapter_correct) as a from deltas group by fact_id)"


@query(f"with {FAMILIES} select case when track = 'control' then 'control' else 'acquisition' end as family_group, count(*) as facts, count(*) filter (b) as base_passes, count(*) filter (a) as adapter_passes, count(*) filter (a and not b) as acquired, count(*) filter (b and not a) as regressed from families group by 1")
def family_groups(spark, folder):
    return C.family_groups(C.families(_runs(spark, folder)))


@query(f"with {FAMILIES} select count(*) filter (a and not b) as acquired, count(*) filter (b and not a) as regressed from families where track <> 'control'")
def robust_changes(spark, folder):
    return C.robust_changes(C.families(_runs(spark, folder)))


@query("select user_id, count(value) as records, round(exp(avg(value / 100)), 9) as perplexity from events group by user_id")
def mean_perplexities(spark, folder):
    rows = C.mean_perplexity(table(spark, folder, "events").withColumn("loss", F.col("value") / 100), "loss", "user_id")
    return rows.withColumn("perplexity", F.round("perplexity", 9))


@query()
def bootstrap_intervals(spark, folder):
    rows = _runs(spark, folder).groupBy("track").agg(C.bootstrap(F.col("delta"), F.col("probe_id")).alias("i"))
    return rows.select("track", "i.low", "i.high")


RECORDINGS = "recordings as (select recording_id, max(recording_s) as d from audio_windows group by recording_id having max(recording_s) > 0)"


def _recordings(spark, folder):
    return table(spark, folder, "audio_windows").groupBy("recording_id").agg(F.max("recording_s").alias("duration_s"))


@query(f"with {RECORDINGS}, w as (select recording_id, d, unnest(generate_series(0, case when d <= 30 then 0 else ceil((d - 30) / 25)::int end)) as i from recordings) select recording_id, i::int as index, i * 25.0::double as start_s, least(i * 25.0 + 30.0, d) as end_s from w")
def sliding_windows(spark, folder):
    return S.sliding(_recordings(spark, folder))


@query(f"with {RECORDINGS} select recording_id, k::int as k, round(d * k / 6, 6) as at_s from recordings, generate_series(1, 5) g(k)")
def frame_timestamps(spark, folder):
    rows = _recordings(spark, folder).where("duration_s > 0")
    return rows.select("recording_id", F.posexplode(S.frame_times(F.lit(0.0), F.col("duration_s"), 5)).alias("at", "t")).select("recording_id", (F.col("at") + 1).cast("int").alias("k"), F.round("t", 6).alias("at_s"))


@query("select distinct recording_id, index, case when starts_with(upper(t), 'MUSIC') then '' else t end as text from (select recording_id, index, trim(regexp_replace(transcript, '<\\|[^|]+\\|>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) as t from audio_windows)")
def clean_transcripts(spark, folder):
    return table(spark, folder, "audio_windows").select("recording_id", "index", T.clean_audio(F.col("transcript")).alias("text")).distinct()


def _transcripts(spark, folder):
    """Each window once, its latest delivery whole."""
    rows = table(spark, folder, "audio_windows").where("recording_id is not null and index is not null")
    kept = ("start_s", "end_s", "transcript", "generation_tokens", "latency_ms")
    order = Window.partitionBy("recording_id", "index").orderBy(F.col("created_at").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in kept])
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select("recording_id", "index", *kept)


WINDOWS = "windows as (select * from (select *, row_number() over (partition by recording_id, index order by created_at desc nulls last, start_s nulls last, end_s nulls last, transcript nulls last, generation_tokens nulls last, latency_ms nulls last) as nth from audio_windows where recording_id is not null and index is not null) where nth = 1)"


@query(f"with {WINDOWS} select recording_id, string_agg(printf('[%.1fs-%.1fs] %s', start_s, end_s, transcript), chr(10) || chr(10) order by index) as text from windows where start_s is not null and end_s is not null and transcript is not null group by recording_id")
def literal_transcripts(spark, folder):
    """All windows with known times and text."""
    rows = _transcripts(spark, folder).where("start_s is not null and end_s is not null and transcript is not null")
    return S.literal(rows)


@query()
def stitched_transcripts(spark, folder):
    return S.stitched(_transcripts(spark, folder)).drop("steps")


@query("""with l as (select user_id, ts, lag(ts) over w as p, lag(value) over w as v from events window w as (partition by user_id order by ts))
select user_id, round(sum(case when v >= 25 then epoch_us(ts) - epoch_us(p) else 0 end) / 1e6, 3) as consumed_s from l group by user_id""")
def active_metering(spark, folder):
    rows = S.metered(table(spark, folder, "events"), "user_id", "ts", "value")
    return rows.groupBy("user_id").agg(F.round(F.max("consumed_s"), 3).alias("consumed_s"))


@query("select user_id, arg_min(event_id, (value, event_id)) as best_step, min(value) as best, arg_max(value, event_id) as last from events where value is not null group by user_id")
def loss_argmin(spark, folder):
    return C.best_step(table(spark, folder, "events"), "event_id", "value", "event_id", "user_id")


ITEMS = "items as (select *, row_number() over (partition by l_orderkey order by l_linenumber) as nth from (select l_orderkey, l_linenumber, sum(l_quantity) as size from lineitem group by all))"


def _items(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("size"))


@query(f"""with recursive {ITEMS}, r as (select l_orderkey, l_linenumber, size, nth, 0 as bin, size as held from items where nth = 1
union all select i.l_orderkey, i.l_linenumber, i.size, i.nth, case when r.held + i.size > 60 then r.bin + 1 else r.bin end, case when r.held + i.size > 60 then i.size else r.held + i.size end from r join items i on i.l_orderkey = r.l_orderkey and i.nth = r.nth + 1)
select l_orderkey, l_linenumber, size, bin from r""")
def bin_packing(spark, folder):
    return S.packed(_items(spark, folder), "l_orderkey", "l_linenumber", "size", 60.0)


@query(f"""with recursive {ITEMS}, r as (select l_orderkey, nth, 0 as w, size as held from items where nth = 1
union all select i.l_orderkey, i.nth, case when r.held >= 60 then r.w + 1 else r.w end, case when r.held >= 60 then i.size else r.held + i.size end from r join items i on i.l_orderkey = r.l_orderkey and i.nth = r.nth + 1)
select l_orderkey, w as "window", max(held) as size from r group by l_orderkey, w having max(held) > 0""")
def chunk_windows(spark, folder):
    return S.chunk_windows(_items(spark, folder), "l_orderkey", "l_linenumber", "size", 60.0)


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders) where n > 2")
def retention(spark, folder):
    return S.beyond_newest(table(spark, folder, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("select name, first, least(first + 999, total - 1) as last from (select p_name || p_partkey as name, total, unnest(generate_series(0, total - 1, 1000)) as first from (select *, (p_retailprice * 3)::bigint as total from part where p_retailprice * 3 >= 1))")
def range_plan(spark, folder):
    files = table(spark, folder, "part").where("p_retailprice * 3 >= 1").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.bround(F.col("p_retailprice") * 3).cast("bigint").alias("total"))
    return S.ranges(files, 1000)


FIELDS = ("base_model_revision", "dataset_revision", "lora_rank", "lora_alpha", "lora_dropout", "target_modules", "max_length", "batch_size", "save_steps")


@query("with p as (select a.run_id, f.* from recipe_manifests a join recipe_manifests b on b.run_id = 'run-01', lateral (values " + ", ".join(f"('{f}', a.{f}::varchar is distinct from b.{f}::varchar)" for f in FIELDS) + ") f(field, differs)) select run_id, field from p where differs")
def manifest_diff(spark, folder):
    rows = table(spark, folder, "recipe_manifests").select("run_id", *FIELDS).dropDuplicates(["run_id"])
    first = rows.where("run_id = 'run-01'").drop("run_id").crossJoin(F.broadcast(rows.select("run_id")))  # one row by the manifests
    return S.differing(rows, first.select("run_id", *FIELDS), "run_id").select("run_id", "field")


COLUMNS = ("base_model_id", "base_model_revision", "batch_size", "dataset_repo_id", "dataset_revision", "flash_attn_version", "gradient_accumulation", "image_digest", "lora_alpha", "lora_dropout", "lora_rank", "max_length", "ms_swift_version", "peft_version", "python_version", "save_steps", "swift_commit", "target_modules", "target_parameters", "torch_version", "transformers_version")


@query("select run_id, lora_rank, lora_dropout, target_modules, image_digest from recipe_manifests")
def manifest_round_trip(spark, folder):
    """Manifests as JSON and back."""
    rows = table(spark, folder, "recipe_manifests")
    schema = rows.schema.simpleString()
    return rows.select(Z.from_record(Z.to_record(F.struct("*")), schema).alias("m")).select("m.run_id", "m.lora_rank", "m.lora_dropout", "m.target_modules", "m.image_digest")


@query("select run_id, sha256(to_json(struct_pack(" + ", ".join(f"{c} := {c}" for c in COLUMNS) + "))::varchar) as hash from recipe_manifests")
def manifest_hashes(spark, folder):
    rows = table(spark, folder, "recipe_manifests")
    return rows.select("run_id", S.manifest_hash([c for c in rows.columns if c != "run_id"]).alias("hash"))


@query("select kind, count(*) as n from (select case when starts_with(p_type, 'S') then 'kept' when starts_with(p_type, 'P') then 'dropped' when starts_with(p_type, 'M') then 'dropped' else 'kept' end as kind from part) group by kind")
def weight_filter(spark, folder):
    kind = S.weight_kind(F.col("p_type"), ("S",), ("P",), ("M",), False)
    return table(spark, folder, "part").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""select p_brand as shard, count(*) filter (keep) as kept, count(*) filter (not keep) as dropped, bool_or(keep) as stays from (select p_brand, starts_with(p_type, 'S') or not (starts_with(p_type, 'P') or starts_with(p_type, 'M') or starts_with(p_type, 'E')) as keep from part) group by p_brand""")
def weight_shards(spark, folder):
    return S.weight_shards(table(spark, folder, "part"), "p_brand", S.weight_kind(F.col("p_type"), ("S",), ("P", "E"), ("M",), False))


def _listing(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Orders as checkpoints of their customers' runs, their items as files; finished orders have a marker."""
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("run_id"), F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("folder"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    files = _items(spark, folder).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("run_id", "folder", F.concat("l_linenumber", F.lit(".bin")).alias("path"), F.col("size").cast("bigint").alias("size"))
    done = orders.where("o_orderstatus = 'F'")
    raw = F.when(F.col("o_orderkey") % 7 == 0, "no JSON").otherwise(F.to_json(F.struct(F.col("o_orderpriority").alias("manifest_hash"))))
    return files.unionByName(done.select("run_id", "folder", F.lit(H.MARKER).alias("path"), F.lit(10).cast("bigint").alias("size"))), done.select("run_id", "folder", raw.alias("raw"))


FOUND = f"""{ITEMS}, found as (select o_custkey as run_id, o_orderkey as step, count(l_linenumber) + (o_orderstatus = 'F')::int as files, (coalesce(sum(size), 0) + case when o_orderstatus = 'F' then 10 else 0 end)::bigint as bytes, o_orderstatus = 'F' as complete,
case when o_orderstatus = 'F' and o_orderkey % 7 <> 0 then o_orderpriority else '' end as manifest_hash from orders left join items on l_orderkey = o_orderkey group by o_custkey, o_orderkey, o_orderstatus, o_orderpriority having count(l_linenumber) > 0 or o_orderstatus = 'F')"""


@query(f"with {FOUND} select * from found")
def checkpoint_inventory(spark, folder):
    return H.checkpoints(*_listing(spark, folder)).drop("folder")


def _recipes(spark, folder):
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("1-URGENT").alias("manifest_hash"))


@query(f"with {FOUND} select run_id, max(step) as step from found where complete and manifest_hash = '1-URGENT' and run_id in (select c_custkey from customer) group by run_id")
def newest_compatible(spark, folder):
    return H.newest(H.checkpoints(*_listing(spark, folder)), _recipes(spark, folder))


@query(f"with {FOUND} select run_id, max(step) as step from found where complete group by run_id")
def newest_complete(spark, folder):
    return H.newest(H.checkpoints(*_listing(spark, folder)))


@query(f"with {FOUND} select run_id, step from found where complete and manifest_hash in ('', '1-URGENT') and run_id in (select c_custkey from customer)")
def seeded_steps(spark, folder):
    return H.seeded(H.checkpoints(*_listing(spark, folder)), _recipes(spark, folder))


@query(f"with {FOUND}, n as (select run_id, step, row_number() over (partition by run_id order by step desc) as nth from found where complete) select run_id, step from n where nth > 2")
def stale_checkpoints(spark, folder):
    return H.stale(H.checkpoints(*_listing(spark, folder))).select("run_id", "step")


@query(f"with {FOUND}, m as (select run_id, max(step) as step from found where complete group by run_id) select m.run_id, m.step, l_linenumber || '.bin' as path, size::bigint as size from m join items on l_orderkey = m.step union all select run_id, step, '_COMPLETE.json', 10 from m")
def restored_files(spark, folder):
    listing, markers = _listing(spark, folder)
    return H.restored(listing, H.newest(H.checkpoints(listing, markers)))


@query(f"""with recursive {ITEMS}, f as (select o_custkey as run_id, o_orderkey as step, l_linenumber || '.bin' as path, size::bigint as size, row_number() over (partition by o_custkey, o_orderkey order by size, l_linenumber) as nth from orders join items on l_orderkey = o_orderkey where l_linenumber <> 5),
r as (select *, 0 as chunk, size as held from f where nth = 1 union all select f.*, case when r.held + f.size > 50 then r.chunk + 1 else r.chunk end, case when r.held + f.size > 50 then f.size else r.held + f.size end from r join f on f.run_id = r.run_id and f.step = r.step and f.nth = r.nth + 1)
select run_id, step, path, size, nth::int as nth, chunk from r""")
def upload_chunks(spark, folder):
    files = _listing(spark, folder)[0].withColumn("step", T.step_of(F.col("folder")))
    return H.upload_plan(files, 50, ("5.b*", "logs/"))


@query("select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49)")
def registered_files(spark, folder):
    held = table(spark, folder, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return H.registered(table(spark, folder, "part").select("p_partkey"), held, "p_partkey")


@query("select user_id, count(*) as files, coalesce(sum(round(value)), 0)::bigint as bytes from events group by user_id")
def folder_sizes(spark, folder):
    return H.folder_sizes(table(spark, folder, "events").select("user_id", F.round("value").cast("bigint").alias("size")), "user_id")


@query("""select event_id, isfinite(v) and v is not null as finite, coalesce(isfinite(v) and v < 12, false) as plausible, round(exp(value / 100), 9) as perplexity, round(greatest(value - 10, 0) / 3600 * 8, 9) as hours, value <= 30.5 as fits,
case when abs(value - 20) < 5 then 'inactive' when abs(value - 40) > 2 * abs(value - 20) + 1e-3 then 'suspect' else 'active' end as activation, (value / 100 - 0.3) <= 0.02 as improved from (select *, case when event_id % 9 = 0 then 'nan'::double when event_id % 11 = 0 then 'inf'::double else value end as v from events where value is not null)""".replace("isfinite(v) and v is not null as finite", "coalesce(isfinite(v), false) as finite"))
def gate_measures(spark, folder):
    value = F.col("value")
    loss = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(value)
    return table(spark, folder, "events").where("value is not null").select(
        "event_id", G.finite(loss).alias("finite"), G.plausible(loss).alias("plausible"), F.round(G.perplexity(value / 100), 9).alias("perplexity"), F.round(G.gpu_hours(F.lit(10.0), value, 8), 9).alias("hours"), G.fitting_duration(value, 30.0).alias("fits"),
        G.activation(F.lit(20.0), value, F.lit(40.0), value, 5.0).alias("activation"), G.improved(F.lit(0.3), value / 100, 0.02).alias("improved"),
    )


@query("select p_partkey, ((case when r = 0 then 0 else ((r - 1) // 2 + 1 - 1) // 2 + 1 end) - case when r = 0 then 0 else 0 end) as halved_twice, (case when r = 0 then 0 else (((r - 1) // 2) // 2) // 2 + 1 end + p_partkey // 100 * 13)::bigint as length from (select p_partkey, p_partkey % 100 as r from part)".replace("((case when r = 0 then 0 else ((r - 1) // 2 + 1 - 1) // 2 + 1 end) - case when r = 0 then 0 else 0 end) as halved_twice, ", ""))
def convolved_lengths(spark, folder):
    return table(spark, folder, "part").select("p_partkey", G.convolved_length(F.col("p_partkey")).alias("length"))


@query("select user_id, event_id as step, value as loss from events where value is not null and event_type <> 'error'")
def trainer_log(spark, folder):
    """Events as log lines; errors have no loss in theirs."""
    e = table(spark, folder, "events")
    raw = F.to_json(F.struct(F.when(F.col("event_type") != "error", F.col("value")).alias("loss"), F.concat(F.col("event_id").cast("string"), F.lit("/9")).alias("global_step/max_steps")))
    lines = e.select(F.col("user_id").alias("shard"), F.col("event_id").alias("line_no"), raw.alias("raw"))
    return L.trainer_log(lines).select(F.col("shard").alias("user_id"), F.col("step").cast("bigint").alias("step"), "loss")


def _outcomes(spark, folder):
    """Documents as editions: some with records already, some with text, some that convert to nothing."""
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("stem"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    kinds = {"pdf": F.lit(True), "jsonl": F.col("doc_id") % 5 == 0, "txt": F.col("doc_id") % 3 == 0}
    listing = None
    for ext, there in kinds.items():
        part = d.where(there).select(F.concat(F.lit("in/"), F.col("stem"), F.lit("." + ext)).alias("path"), F.lit(9).cast("bigint").alias("length"))
        listing = part if listing is None else listing.unionByName(part)
    texts = d.where("doc_id % 3 <> 0").select("stem", F.when(F.col("n") == 0, "no text in it").alias("error"))
    return E.outcomes(L.edition_status(listing), texts, d.where("n > 200").select("stem"))


OUTCOMES = """outcomes as (select doc_id::varchar as stem, case when doc_id % 5 = 0 then 'skipped' when doc_id % 3 = 0 then 'reused' else 'extracted' end as plan, case when doc_id % 3 <> 0 and coalesce(length(text), 0) = 0 then 'no text in it' when coalesce(length(text), 0) <= 200 and doc_id % 5 <> 0 then 'no records' end as error from documents)"""


@query(f"with {OUTCOMES} select stem, case when error is not null then 'failed' else plan end as status, error from outcomes")
def batch_outcomes(spark, folder):
    return _outcomes(spark, folder)


@query(f"with {OUTCOMES}, s as (select case when error is not null then 'failed' else plan end as s from outcomes) select count(*) as scanned, count(*) filter (s = 'skipped') as skipped, count(*) filter (s = 'reused') as reused, count(*) filter (s = 'extracted') as extracted, count(*) filter (s = 'failed') as failed from s")
def batch_summary(spark, folder):
    return E.batch_summary(_outcomes(spark, folder))


@query("select shard, line_no, row_number() over (order by tokens, shard, line_no) as place from (select distinct shard, line_no, length(content) as tokens from validated_records where trim(content) <> '' and length(content) > 3000)")
def token_order(spark, folder):
    """The place of the longest records in order of their tokens."""
    rows = _valid(spark, folder).where("tokens > 3000").select("shard", "line_no", "tokens").distinct()
    ordered = S.running(rows.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("tokens") / 64), ["tokens", "shard", "line_no"], F.lit(1), "place")
    return R.in_token_order(ordered).select("shard", "line_no", F.col("place").cast("bigint").alias("place"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes and reads again, beside the checkpoints."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{named}/{name}-{uuid.uuid4().hex}"


@query("select source, sha256(regexp_replace(content, '^\\s+|\\s+\\z', '', 'g')) as digest, count(*) as n from (select distinct source, ordinal, content from corpus_records where content is not null and source is not null) group by all")
def shards_round_trip(spark, folder):
    """Records written as shards of their sources and read again."""
    at = _scratch(spark, "shards")
    written = L.write_shards(_records(spark, folder).where("source is not null"), at)
    back = spark.read.text(at).select(F.col("source").cast("string").alias("source"), F.lit("").alias("shard"), F.lit(0).alias("line_no"), F.col("value").alias("raw"))
    content = T.stripped(F.try_variant_get(F.try_parse_json("raw"), "$.messages[0].content", "string"))
    rows = back.groupBy("source", F.sha2(content, 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.lit(written == back.count()))


@query(SPLIT + """ select split, (select count(*) from split o where o.split = s.split) as records, sha256(regexp_replace(any_value(content), '^\\s+|\\s+\\z', '', 'g')) as digest from split s join kept using (digest, shard, line_no, tokens) group by split, digest""")
def split_round_trip(spark, folder):
    """The training and the evaluation side written as JSON lines, and the digests of what is packed in them."""
    at = _scratch(spark, "split")
    L.write_split(R.with_split(R.windowed(_valid(spark, folder)).where("status = 'kept'")), f"{at}/train", f"{at}/eval")
    sides = [spark.read.text(f"{at}/{side}").select(F.lit(side).alias("split"), F.col("value").alias("raw")) for side in ("train", "eval")]
    out = None
    for side in sides:
        counted = L.packed_digests(side).crossJoin(F.broadcast(side.groupBy("split").agg(F.count(F.lit(1)).alias("records"))))  # one row by the digests
        out = counted if out is None else out.unionByName(counted)
    return out.select("split", "records", "digest")


@query("""with f as (select p_brand as run_id, p_size::bigint as step, p_retailprice::bigint as size, p_partkey % 40 <> 0 as still from part) select run_id, step, sum(size)::bigint as bytes from f group by all having bool_and(still)""")
def sync_ledger(spark, folder):
    """The ledger after two passes of the sync: parts as files of checkpoints, some still growing at the second look."""
    at = _scratch(spark, "sync")
    files = table(spark, folder, "part").select(F.col("p_brand").alias("run_id"), F.concat(F.lit("checkpoint-"), F.col("p_size").cast("string")).alias("folder"), F.col("p_partkey").cast("string").alias("path"), F.bround("p_retailprice").cast("bigint").alias("size"), "p_partkey")
    for n, size in enumerate((F.col("size"), F.col("size") + (F.col("p_partkey") % 40 == 0).cast("int"))):
        seen = F.lit(f"2024-01-01 00:0{n}:00").cast("timestamp").alias("seen_at")
        files.select("run_id", "folder", "path", size.alias("size"), seen).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema("run_id string, folder string, path string, size bigint, seen_at timestamp").parquet(f"{at}/in")
        sync(stream, f"{at}/ledger", lambda run, step, paths: None, lambda run, step: None, f"{at}/state", most_bytes=5_000).awaitTermination()
    return spark.read.parquet(f"{at}/ledger").select("run_id", "step", "bytes")


@query("""select record_id, regexp_matches(h, '(?i)\\bSUPREME COURT OF BARBADOS\\b') or regexp_matches(h, '(?i)\\bNOTICE OF APPLICATION FOR DECLARATION OF OWNERSHIP\\b') or regexp_matches(h, '(?i)\\bIN THE MATTER OF THE LAND \\(TITLE PROCEEDINGS\\) ACT\\b') or regexp_matches(h, '(?i)\\bCLAIM NO\\.\\s*[A-Z0-9/-]+') as legal
from (select distinct record_id, substr(case when record_id % 3 = 0 then 'In the Supreme Court of Barbados. ' when record_id % 7 = 0 then repeat('x ', 300) || 'CLAIM NO. 12/3' else '' end || content, 1, 500) as h from corpus_records where content is not null)""")
def legal_notices(spark, folder):
    """Records, some of them begun as legal notices."""
    start = F.when(F.col("record_id") % 3 == 0, "In the Supreme Court of Barbados. ").when(F.col("record_id") % 7 == 0, F.concat(F.repeat(F.lit("x "), 300), F.lit("CLAIM NO. 12/3"))).otherwise("")
    rows = table(spark, folder, "corpus_records").where("content is not null").withColumn("content", F.concat(start, "content"))
    return rows.select("record_id", K.is_legal_notice(F.col("content")).alias("legal")).distinct()


@query("select event_id, case when event_id % 5 = 0 or value is null then 0 else value end as watts from events")
def power_readings(spark, folder):
    """Values as a sensor prints them, some not available."""
    raw = F.when(F.col("event_id") % 5 == 0, F.when(F.col("event_id") % 2 == 0, " N/A ").otherwise("  ")).otherwise(F.coalesce(F.concat(F.lit(" "), F.col("value").cast("decimal(18,6)").cast("string"), F.lit(" W")), F.lit("")))
    return table(spark, folder, "events").select("event_id", T.watts(raw).alias("watts"))


@query("select p_brand as run_id from part group by p_brand having count(distinct case when p_partkey % 50 < 3 then p_partkey % 50 end) = 3 and bool_and(p_size <> 9 or p_partkey % 50 >= 3)")
def complete_folders(spark, folder):
    """Folders with three expected files whose sizes were the same before."""
    rows = table(spark, folder, "part").select(F.col("p_brand").alias("run_id"), (F.col("p_partkey") % 50).cast("string").alias("path"), (F.col("p_size") == 9).alias("grows"))
    files = rows.groupBy("run_id", "path").agg(F.bool_or("grows").alias("grows"))
    return S.complete(files.select("run_id", "path", F.lit(5).alias("size")), files.select("run_id", "path", F.when(F.col("grows"), 4).otherwise(5).alias("size")), ["0", "1", "2"])


@query("""with l as (select user_id, ts, lag(ts) over w as p, lag(value) over w as v from events window w as (partition by user_id order by ts))
select user_id::varchar as run_id, round(sum(case when v >= 25 then epoch_us(ts) - epoch_us(p) else 0 end) / 1e6, 3) as consumed_s from l group by user_id""")
def stream_metering(spark, folder):
    """The metering stream, run to the end of what is there; equals the batch query."""
    at = _scratch(spark, "metering")
    shape = table(spark, folder, "events").schema
    # a file is found by its name in the folder, a folder of files is a source of its own
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    stream = spark.readStream.schema(shape)
    stream = stream.parquet(f"{folder}/events.parquet") if whole else stream.option("pathGlobFilter", "events.parquet").parquet(folder)
    rows = metering(stream.select(F.col("user_id").cast("string").alias("run_id"), F.col("ts"), F.col("value").alias("watts")))
    run = rows.writeStream.foreachBatch(lambda part, n: part.write.mode("overwrite").parquet(f"{at}/out/n={n}")).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("run_id").agg(F.round(F.max_by("consumed_s", "samples"), 3).alias("consumed_s"))
