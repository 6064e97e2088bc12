"""Queries of the protocol, hidden text, slide and source operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import hidden, ligature, protocol, slides, validate
from ..sources import tables
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, turns, raw): conversations as JSON replies, some fenced, some cut short, some within prose."""
    c = I.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("string").alias("id"), F.col("text").alias("output")))).alias("items"))
    js = F.to_json("items")
    raw = F.when(F.col("conv_id") % 4 == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).when(F.col("conv_id") % 4 == 2, F.expr("left(to_json(items), length(to_json(items)) - int(conv_id % 3) - 1)")).when(F.col("conv_id") % 4 == 3, F.concat(F.lit("as [asked]: "), js, F.lit(" done"))).otherwise(js)
    return c.select(F.col("conv_id").alias("id"), F.size("items").alias("turns"), raw.alias("raw"))


@query("select conv_id as id, count(*) as n, false or (conv_id % 4 = 2) as repaired from conversations group by conv_id")
def j03_parse_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.parsed(_replies(spark, sf_dir)).select("id", F.size("items").cast("long").alias("n"), "repaired")


@query("select conv_id as id, conv_id % 4 <> 2 as found from (select distinct conv_id from conversations)")
def j01_last_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.array_places(_replies(spark, sf_dir)).select("id", (F.col("begin") >= 0).alias("found"))


#: conversations as the JSON that ``_replies`` makes of them: js whole, raw as replied.
_REPLIES = """(select id, case id % 4 when 1 then '```json' || chr(10) || js || chr(10) || '```' when 2 then left(js, length(js) - id % 3 - 1) when 3 then 'as [asked]: ' || js || ' done' else js end as raw from (
  select conv_id as id, '[' || string_agg('{"id":"' || turn || '","output":' || cast(to_json(text) as varchar) || '}', ',' order by cast(turn as varchar), text) || ']' as js from conversations group by conv_id))"""


@query(f"""select id, case id % 4 when 0 then n when 1 then '```json' || chr(10) || n || chr(10) || '```' when 3 then 'as [asked]: ' || n || ' done' else raw end as raw from (
  select id, raw, '[{{"id":' || id || ',"output":"x"}}]' as n from {_REPLIES})""")
def j02_swap_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _replies(spark, sf_dir)
    p = r.join(protocol.array_places(r), "id")
    items = F.array(F.struct(F.col("id").alias("id"), F.lit("x").alias("output")))
    new = protocol.swapped(F.col("raw"), F.col("begin"), F.col("stop"), items)
    return p.select("id", F.when(F.col("begin") >= 0, new).otherwise(F.col("raw")).alias("raw"))


@query(f"""select id, case when id % 2 = 0 then length(lead) else -1 end as begin, case when id % 2 = 0 then length(lead) + length(js) else -1 end as stop from (
  select id, case id % 3 when 0 then 'see [[x]] ] then ' when 1 then '] [1, 2] [[ ' else '[{{"id": broken]] ' end as lead, js from (select conv_id as id, '[' || string_agg('{{"id":"' || turn || '","output":' || cast(to_json(text) as varchar) || '}}', ',' order by cast(turn as varchar), text) || ']' as js from conversations group by conv_id))""")
def j01_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays among other brackets; every second one is cut in two, so that nothing is left to be found."""
    c = I.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").cast("string").alias("id"), F.col("text").alias("output")))).alias("items"))
    n = F.col("conv_id") % 3
    lead = F.when(n == 0, "see [[x]] ] then ").when(n == 1, "] [1, 2] [[ ").otherwise('[{"id": broken]] ')
    js = F.to_json("items")
    raw = F.concat(lead, F.when(F.col("conv_id") % 2 == 0, js).otherwise(F.concat(F.lit("["), F.substring(js, F.lit(3), F.length(js)))), F.lit(" [and] so [ on"))
    return protocol.array_places(c.select(F.col("conv_id").alias("id"), raw.alias("raw"))).select("id", F.col("begin").cast("long").alias("begin"), F.col("stop").cast("long").alias("stop"))


@query("select conv_id as id, case when conv_id % 4 = 0 then count(distinct turn) else 0 end as n from conversations group by conv_id")
def j04_client_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("id", F.size(F.map_keys(protocol.client_reply(F.col("raw")))).cast("long").alias("n"))


@query(f"""select id, md5('{{"object":"chat.completion","created":0,"model":"m","choices":[{{"index":0,"message":{{"role":"assistant","content":' || cast(to_json(raw) as varchar) || '}},"finish_reason":"stop"}}]}}') as body from {_REPLIES}""")
def j05_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("id", F.md5(protocol.envelope(F.col("raw"), F.lit("m"), F.lit(0))).alias("body"))


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, data): each document's lines as show operators, every third outside of the clip.

    Texts of odd length are drawn at twice their size and half the numbers, with the string before its place.
    """
    odd = F.length("text") % 2 == 1
    line = lambda x, i: F.regexp_replace(x, r"[()\\]", ".")  # noqa: E731, ARG005
    place = lambda i, far, near: F.when(i % 3 == 2, F.lit(far)).otherwise(F.lit(near))
    shown = lambda x, i: F.when(odd, F.concat(F.lit("BT ("), line(x, i), F.lit(") "), place(i, "250 250", "5 5"), F.lit(" Td Tj ET"))).otherwise(F.concat(F.lit("BT "), place(i, "500 500", "10 10"), F.lit(" Td ("), line(x, i), F.lit(") Tj ET")))
    body = F.array_join(F.transform(F.split("text", "\n"), shown), "\n")
    head = F.when(odd, F.lit("q 2 0 0 2 0 0 cm 0 0 50 50 re W n\n")).otherwise(F.lit("q 0 0 100 100 re W n\n"))
    return I.table(spark, sf_dir, "documents").select(F.lit("b").alias("doc"), F.col("doc_id").alias("page"), F.encode(F.concat(head, F.regexp_replace(body, r"[^\x00-\x7f]", "?"), F.lit("\nQ")), "UTF-8").alias("data"))


@query("""select page, cast(coalesce(sum(length(l)) filter (i % 3 = 0), 0) as bigint) as hidden, cast(coalesce(sum(length(l)) filter (i % 3 <> 0), 0) as bigint) as shown from (
  select doc_id as page, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) group by page""")
def h06_hidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden.scan(_streams(spark, sf_dir)).select("page", "hidden", "shown")


@query("""select page from (select doc_id as page, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where i % 3 = 0 group by page having sum(length(l)) >= 40""")
def h07_hidden_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden.scan(_streams(spark, sf_dir)).where(hidden.many_hidden()).select("page")


@query("""select page, case when coalesce(max(length(l)) filter (i % 3 = 0), 0) >= 3 then 'blocks' when count(*) filter (i % 3 = 0) > 0 then 'operators' else 'kept' end as way, cast(0 as bigint) as lost from (
  select doc_id as page, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) group by page""")
def h08_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = _streams(spark, sf_dir).withColumn("boxes", F.array().cast("array<array<double>>")).withColumn("visible", F.array().cast("array<string>"))
    return hidden.cleaned(none, hidden.visible_words).select("page", "way", "lost")


_HIDDEN = """l as (select doc_id as page, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
  w as (select page, l, i % 3 = 0 as hidden, len(list_filter(string_split_regex(l, '\\s+'), lambda x: x <> '')) as n from l)"""


@query(f"""with {_HIDDEN}, p as (select page, sum(n) as every, coalesce(sum(n) filter (hidden and length(l) >= 3), 0) as b, count(*) filter (hidden and length(l) >= 3) > 0 as has_b, coalesce(sum(n) filter (hidden), 0) as o, count(*) filter (hidden) > 0 as has_o from w group by page)
  select page, case when has_b and b <= 3 and b <= 0.2 * every then 'blocks' when has_o and o <= 3 and o <= 0.2 * every then 'operators' when has_b or has_o then 'rolled back' else 'kept' end as way,
    cast(case when has_b and b <= 3 and b <= 0.2 * every then b when has_o then o when has_b then b else 0 end as bigint) as lost from p""")
def h10_rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that sees hidden words too: pages that would lose too many of them stay as they are."""
    none = _streams(spark, sf_dir).withColumn("boxes", F.array().cast("array<array<double>>")).withColumn("visible", F.array().cast("array<string>"))
    return hidden.cleaned(none, hidden.all_words).select("page", "way", "lost")


@query(f"""with {_HIDDEN}, p as (select page, count(*) filter (hidden and length(trim(l)) < 3) as short, count(*) filter (hidden) as every from w group by page)
  select page, case when length(text) % 4 < 2 then 'kept' when short > 0 then 'operators' else 'kept' end as way from p join documents on doc_id = page""")
def h09_near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden lines that say what is visible stay; of the others those that start near a visible word's box, which half of the pages have there."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(F.regexp_replace(F.regexp_replace(x, r"[()\\]", "."), r"[^\x00-\x7f]", "?"))), lambda x: x != "")
    box = F.array(*(F.array(*(F.lit(float(v)) for v in (490, 490, 510, 510))) for _ in range(1)))
    said = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), lines.alias("visible"), F.when(F.length("text") % 4 < 2, box).otherwise(F.array().cast("array<array<double>>")).alias("boxes"))
    return hidden.cleaned(_streams(spark, sf_dir).join(said, "page"), hidden.visible_words).select("page", "way")


@query("""with w as (select doc_id as page, unnest(string_split(text, ' ')) as w from documents), c as (select page, w, count(*) as n from w group by all)
  select page, cast(sum(case when regexp_matches(w, '[A-Z]') then n else 0 end) as bigint) as lost, sum(case when regexp_matches(w, '[A-Z]') then n else 0 end) <= 3 and sum(case when regexp_matches(w, '[A-Z]') then n else 0 end) / sum(n)::double <= 0.2 as ok from c group by page""")
def h10_loss_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, rest = I.rows_of_their_own(I.table(spark, sf_dir, "documents").select("doc_id", "text"))
    small = lambda w: ~F.regexp_like(w, F.lit("[A-Z]"))
    at = (F.lit("b").alias("doc"), F.col("doc_id").alias("page"))
    whole = d.select(*at, F.split("text", " ").alias("before")).withColumn("after", F.filter("before", small))
    # texts too long for a row and repeated ids: word by word
    w = rest.select(*at, F.explode(F.split("text", " ")).alias("w"))
    both = w.withColumn("side", F.lit("before")).unionByName(w.where(small(F.col("w"))).withColumn("side", F.lit("after")))
    return hidden.accepted_pages(whole).unionByName(hidden.accepted(both)).select("page", "lost", "ok")


@query("select doc_id from documents where regexp_matches(text, '\\p{L}')")
def p02_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").where(slides.wanted()).select("doc_id")


@query("select source as deck, w as text, row_number() over (partition by source order by min(struct_pack(p := doc_id, i := i))) as n from (select source, doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) as w, generate_subscripts(string_split(replace(text, chr(10), ' '), ' '), 1) as i from documents) where regexp_matches(w, '\\p{L}') and w not like '%<%' group by source, w")
def p03_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each word between blanks in an element of its own
    xml = F.concat(F.lit("<a:t>"), F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit("</a:t><a:t>")), F.lit("</a:t>"))
    return slides.unreachable(I.table(spark, sf_dir, "documents").select(F.col("source").alias("deck"), F.col("doc_id").alias("pos"), xml.alias("xml"))).withColumn("n", F.col("n").cast("long"))


@query(f"select id, hangul + 0.5 * (n - hangul) <= 0 or ((hangul + 0.5 * (n - hangul)) / greatest(1.0, 200.0 / 18)) * 18 * 1.25 <= 600 * 1.05 as fits from (select id, length(tgt) as n, length(regexp_replace(tgt, '[^가-힣]', '', 'g')) as hangul from {I.PAIRS})")
def p04_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.pairs(I.table(spark, sf_dir, "documents"))
    return d.select("id", slides.fits(F.col("tgt"), F.lit(200.0), F.lit(600.0), F.lit(None).cast("double"), F.lit("body")).alias("fits"))


@query("""with r as (select doc_id as slide, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
  m as (select slide, arg_max(i, length(t) * 100000 - i) as main from r group by slide)
  select r.slide, i, md5(case when r.slide % 2 = 1 then t when i = main then 'new' else '' end) as text from r join m on m.slide = r.slide""")
def p05_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slide"), F.array(F.lit("0")).alias("path"), F.lit(0).alias("para"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    new = d.select("slide", "path", "para").distinct().where("slide % 2 = 0").withColumn("text", F.lit("new"))
    return slides.applied(d, new).select("slide", F.col("i").cast("long").alias("i"), F.md5("text").alias("text"))


@query("select doc_id, coalesce(cast(round(case when length(text) % 3 = 0 then null else greatest(8.0, (length(text) % 50) * 0.85) end * 100) as bigint), -1) as size from documents")
def p06_shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.length("text") % 3 != 0, (F.length("text") % 50).cast("double"))
    return I.table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.round(slides.shrunk(size) * 100).cast("long"), F.lit(-1)).alias("size"))


@query(f"select id, case when length(regexp_replace(tgt, '[^\\p{{L}}]', '', 'g')) = 0 or length(regexp_replace(tgt, '[^가-힣]', '', 'g')) / cast(length(regexp_replace(tgt, '[^\\p{{L}}]', '', 'g')) as double) >= 0.3 then 'keep' else 'echoed' end as verdict from {I.PAIRS}")
def p07_reply_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pairs(I.table(spark, sf_dir, "documents")).select("id", slides.verdict(F.col("tgt")).alias("verdict"))


@query("select doc_id, (length(text) % 17) * 100 // greatest(length(text) % 23 + length(text) % 5, 1) as percent from documents")
def p08_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.length("text")
    return I.table(spark, sf_dir, "documents").select("doc_id", slides.progress(c % 17, c % 23, c % 5).alias("percent"))


@query("select l || '↵' || r as source, l || 'ff' || r as target, 'ko' as tgt_lng from (select distinct unnest(regexp_extract_all(text, '([A-Za-z]+)↵(-?[A-Za-z]+)', 1)) as l, unnest(regexp_extract_all(text, '([A-Za-z]+)↵(-?[A-Za-z]+)', 2)) as r from " + I.DAMAGED + ") where l = lower(l)")
def s11_glossary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ligature.pairs(I.damaged(I.table(spark, sf_dir, "documents")))
    t = p.select(F.concat("l", F.lit("ff"), "r").alias("term"), F.array(F.concat("l", F.lit("↵"), "r")).alias("surfaces"), F.when(F.col("l") == F.lower("l"), F.concat("l", F.lit("ff"), "r")).alias("target"))
    return tables.glossary_rows(t)


@query("select doc_id as doc, count(*) filter (len(c) >= 2 and c[len(c) - 1] = 'no') as fonts from (select doc_id, string_split_regex(trim(l), '\\s+') as c from (select doc_id, unnest(string_split(replace(text, 'the', 'no'), chr(10))) as l from documents)) group by doc_id")
def s08_font_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.split(F.replace("text", F.lit("the"), F.lit("no")), "\n")).alias("line"))
    return tables.fonts_without_unicode(lines)


@query("select doc_id, len(regexp_extract_all(replace(text, ' th', '</style>th'), '</style>')) <> len(regexp_extract_all(replace(text, ' an', '<style id=''1''>an'), '<style id=''1''>')) as dropped from documents")
def v06_style_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags before one syllable in the source and before another in the target."""
    src, tgt = F.replace("text", F.lit(" th"), F.lit("</style>th")), F.replace("text", F.lit(" an"), F.lit("<style id='1'>an"))
    return I.table(spark, sf_dir, "documents").select("doc_id", validate.style_dropped(src, tgt).alias("dropped"))


@query("select source, cast(sum(length(text) - length(replace(text, '↵', ''))) as bigint) as marks from " + I.DAMAGED + " group by source")
def x03_damage_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.damaged(I.table(spark, sf_dir, "documents"))
    return d.groupBy("source").agg(F.sum(X.count_of(F.col("text"), X.DAMAGE)).cast("long").alias("marks"))
