"""The query of each training-data operator, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelake.llm import licenses, linededup, media, packing, pii, pivots, simhash, subword, toolcalls, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, found on the machine that reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_subword_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of every document, drawn without replacement, and the checksum of what each decodes to."""
    path = vocabulary("piece_bpe_32k.model")
    return subword.encode(_table(spark, sf_dir, "documents"), path, decoded=True)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents at three bits or fewer."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as MPEG audio, read back, checked and described, with the offsets of its frames."""
    return media.analyse(media.store(_table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, by a model of the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as calls with their results, in topological order within a conversation by (level, turn, place)."""
    parts = toolcalls.parse(_table(spark, sf_dir, "conversations"), toolcalls.turn_parts)
    return toolcalls.link(parts, toolcalls.TURN_SCHEMAS)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document, by base phrases and by diagonal voting."""
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    joined = [F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels")]
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["from"], s["to"])), ",").alias("spans")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score", spans)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand elsewhere first."""
    return linededup.deduplicate(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "removed_lines")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by the fixed patterns and the semi-Markov field."""
    return pii.find(_table(spark, sf_dir, "documents")).drop("base")


def op10_embedding_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts and components of all vectors at a cosine of 0.9."""
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_subword_sampling, op2_simhash, op3_mpeg_audio, op4_toxicity, op5_packing, op6_tool_calls, op7_licenses, op8_line_dedup, op9_pii, op10_embedding_pivots)
    return {f.__name__: f for f in own}


#: Each question is a call and each answer the result of the turn before, as in toolcalls.turn_parts; a call's level counts the calls two, four, ... turns before it.
TOOL_CALLS_SQL = r"""
with said as (select conv_id, turn, role, coalesce(text, '') as text, role is not distinct from 'assistant' as answers from conversations),
calls as (select *, row_number() over (partition by conv_id, turn) as nth from said where not answers),
firsts as (select *, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) as chain from calls where nth = 1 and turn is not null),
levels as (select conv_id, turn, row_number() over (partition by conv_id, turn % 2, chain order by turn) - 1 as level from firsts),
results as (select conv_id, turn - 1 as call, count(*) as n, min(turn) as turn, min(text) as text from said where answers and turn is not null group by 1, 2),
rated as (select c.*, l.level, r.n, r.turn as result_turn, r.text as content, c.turn > 1 and b.turn is null as unknown,
  concat_ws(';', case when c.role is null then '$.role:type' when c.role not in ('user', 'system') then '$.role:enum' end, case when c.text = '' then '$.text:minLength' end,
    case when not regexp_matches(c.text, '\S') then '$.text:pattern' end, case when c.turn is null then '$.turn:type' when c.turn < 0 then '$.turn:minimum' end) as errors
  from calls c left join levels l on c.conv_id is not distinct from l.conv_id and c.turn = l.turn and c.nth = 1
  left join results r on c.conv_id is not distinct from r.conv_id and c.turn = r.call and c.nth = 1
  left join levels b on c.conv_id is not distinct from b.conv_id and c.turn - 2 = b.turn)
select conv_id, turn, cast(0 as integer) as place, cast(turn as varchar) as id, case when role = 'user' then 'answer' else 'instruct' end as name,
  case when turn is null then 0 else level end as level, nth > 1 and turn is not null as duplicate, cast(coalesce(unknown and nth = 1, false) as integer) as unknown_after, coalesce(n, 0) as n_results, result_turn,
  coalesce(result_turn < turn, false) as early, errors = '' as valid, errors,
  concat('{"after":[', case when turn > 1 then concat('"', turn - 2, '"') end, '],"arguments":{"role":', coalesce(to_json(role)::varchar, 'null'), ',"text":', to_json(text), ',"turn":', coalesce(turn::varchar, 'null'), '},"id":',
case when turn is null then 'null' else concat('"', turn, '"') end, ',"name":"', case when role = 'user' then 'answer' else 'instruct' end, '"', case when n > 0 then concat(',"result":', to_json(content)) end, '}') as json
from rated
union all
select r.conv_id, null, null, cast(r.call as varchar), null, null, false, 0, r.n, r.turn, false, null, '', concat('{"id":"', r.call, '","result":', to_json(r.text), '}')
from results r where not exists (select 1 from calls c where c.conv_id is not distinct from r.conv_id and c.turn = r.call)
union all
select conv_id, null, null, null, null, null, false, 0, 1, null, false, null, '', concat('{"id":null,"result":', to_json(text), '}') from said where answers and turn is null
"""

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _licenses_sql() -> str:
    """The votes of all word 4-grams on the templates' own, diagonals merged as windows over them, and the base phrases."""
    k, quoted = licenses.K, lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({t}, {quoted(label)}, {n}, {p}, {quoted(w)})" for t, label, n, p, w in licenses.known_grams())
    phrases = ", ".join(f"({len(p.split())}, {quoted(p)}, {quoted(label)})" for p, label in licenses.BASE)
    near = f"diagonal - lag(diagonal) over w > {licenses.DRIFT} or low > lag(high) over w + {licenses.GAP} or high < lag(low) over w - {licenses.GAP}"
    return rf"""
with docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS.upper()}', '{LETTERS}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
known(template, label, grams, place, wording) as (values {known}),
phrases(size, phrase, label) as (values {phrases}),
words as (select r, generate_subscripts(w, 1) - 1 as p, unnest(w) as word from docs),
places as (select r, p, concat_ws(' ', word, second) as two, concat_ws(' ', word, second, third) as three, concat_ws(' ', word, second, third, lead(word, 3) over q) as gram
  from (select *, lead(word) over q as second, lead(word, 2) over q as third from words window q as (partition by r order by p)) window q as (partition by r order by p)),
votes as (select r, template, p - place as diagonal, p, place from places join known on gram = wording),
tallied as (select r, template, diagonal, min(p) as low, max(p) as high, list(distinct place) as covered from votes group by all),
parted as (select *, sum(apart) over (partition by r, template order by diagonal) as part from (select *, case when {near} then 1 else 0 end as apart from tallied window w as (partition by r, template order by diagonal))),
spans as (select r, template, min(low) as a, max(high) + {k - 1} as b, len(list_distinct(flatten(list(covered)))) as n from parted group by r, template, part),
good as (select r, label, a, b, n / grams as cover from spans join (select distinct template, label, grams from known) using (template) where n / grams >= {licenses.COVER}),
voted as (select r, list(distinct label) as labels, max(cover) as best, string_agg(concat(label, ':', a, ':', b), ',' order by label, a, b, cover) as spans from good group by r),
base as (select r, count(*) as n, min(p) as low, max(p) as high, list(distinct label) as labels from places join phrases on phrase = case size when 2 then two else three end group by r)
select doc_id, len(w) as n_words, coalesce(base.n, 0) as n_base, base.low as first_word, base.high as last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(voted.labels, [])))), ','), '') as labels,
  case when base.n > 0 then 1.0::double else coalesce(best, 0.0)::double end as score, coalesce(spans, '') as spans
from docs left join base using (r) left join voted using (r)"""


#: All pairs of vectors, and components as what chains of links reach. The index has to find every link for these rows to be equal.
EMBEDDINGS_SQL = f"""
with recursive numbered as (select row_number() over () as r, vec_id, embedding from embeddings),
sound as (select r, vec_id, list_transform(embedding, lambda x: x::double) as e from numbered
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.r as a, b.r as b from sound a join sound b on a.r <> b.r and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {pivots.THRESHOLD}),
reached(r, goal) as (select r, r from sound union select reached.r, links.b from reached join links on links.a = reached.goal),
lowest as (select reached.r, min(vec_id) as low from reached join sound on sound.r = reached.goal group by 1),
degree as (select a as r, count(*) as n from links group by 1)
select vec_id, coalesce(n, 0) as n_links, coalesce(low, vec_id) as component_id, coalesce(vec_id = coalesce(low, vec_id), false) as kept from numbered left join degree using (r) left join lowest using (r)"""


def oracle_sql() -> dict[str, str]:
    """SQL for linking, voting and cosines; the others need fingerprints, lattices, frames, learning, tokens, rolling hashes or a random field."""
    return {"op6_tool_calls": TOOL_CALLS_SQL, "op7_licenses": _licenses_sql(), "op10_embedding_pivots": EMBEDDINGS_SQL}
