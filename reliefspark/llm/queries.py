"""Registered queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm import bpe, decontaminate, fim, language, line_dedup, mixing, phrases, pii, quality, simhash, toxicity, url_filter, warc
from reliefspark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def remainder(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query("op6_benchmark_decontamination", rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w
      from benchmark where text is not null and item_id is not null),
bw as (select item, least(10, len(w)) as n, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0),
win as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as s from bw),
sizes as (select distinct n from win),
dw as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
dwin as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as s from dw),
found as (select doc_id, item, n, i from dwin join win using (n, s)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
own as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join own using (doc_id)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 10-word windows of benchmark items."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text and what they decode to, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), RANKS, PATTERN, with_ids=False)


@query("op8_simhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and the components of those within two bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text; learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, remainder(4) != 2)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op10_line_dedup", r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
often as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(o.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where o.key is null), '')) as kept_sha256
from k left join often o using (key) group by doc_id""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.with_kept_text(docs, line_dedup.keep_bitmaps(docs, min_docs=10))
    return kept.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": "[0-9]([ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]", "iban": pii.PATTERNS["iban"], "ssn": pii.PATTERNS["ssn"], "tel": pii.PATTERNS["tel"]}
_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(h, '.'), lambda p: len(ltrim(p, '0')) <= 3 and cast('0' || right(p, 3) as int) <= 255))",
    "card": "len(d) between 13 and 19 and list_sum(list_transform(range(1, len(d) + 1), lambda i: case when i % 2 = 1 then cast(substr(d, len(d) - i + 1, 1) as int) "
            "else (2 * cast(substr(d, len(d) - i + 1, 1) as int)) // 10 + (2 * cast(substr(d, len(d) - i + 1, 1) as int)) % 10 end)) % 10 = 0",
    "phone": "len(d) between 9 and 15",
    "iban": "len(c) between 15 and 34 and list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(c[5:] || c[:4], ''), "
            "lambda x: case when x >= 'A' then cast(ascii(x) - 55 as varchar) else x end), ''), ''), lambda x: cast(x as bigint)), lambda a, b: (a * 10 + b) % 97) = 1",
    "ssn": "true", "tel": "true"}


def _pii_sql() -> str:
    kinds = pii.BASE + pii.FURTHER
    hits = " union all ".join(
        f"select doc_id, t, '{kind}' as kind, {n} as place, unnest(regexp_extract_all(t, '{_PLAIN[kind]}')) as h, unnest(string_split_regex(t, '{_PLAIN[kind]}')) as gap, "
        f"unnest(range(1, len(regexp_extract_all(t, '{_PLAIN[kind]}')) + 1)) as i from t where regexp_matches(t, '{_PLAIN[kind]}')" for n, kind in enumerate(kinds))
    valid = " ".join(f"when '{kind}' then {_VALID[kind]}" for kind in kinds)
    points = " ".join(f"when '{kind}' then {pii.POINTS[kind]} + case when regexp_matches(around, '{pii.CONTEXT[kind]}') then {pii.NEAR} else 0 end" for kind in pii.FURTHER)
    return f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
raw as (select * from ({hits}) where h is not null),
placed as (select *, regexp_replace(h, '[^0-9]', '', 'g') as d, replace(h, ' ', '') as c,
             cast(sum(len(gap) + len(h)) over (partition by doc_id, kind order by i) as bigint) as stop from raw),
found as (select *, stop - len(h) as start from placed where case kind {valid} end),
base as (select * from found where place < {len(pii.BASE)}),
more as (select f.*, lower(substr(t, greatest(start - {pii.BEFORE}, 0) + 1, start - greatest(start - {pii.BEFORE}, 0)) || '|' || substr(t, stop + 1, {pii.BEHIND})) as around
         from found f where place >= {len(pii.BASE)}
         and not regexp_matches(case when start > 0 then substr(t, start, 1) else '' end || substr(t, stop + 1, 1), '[A-Za-z0-9+-]')
         and not exists (select 1 from base b where b.doc_id = f.doc_id and b.start < f.stop and b.stop > f.start)),
added as (select * from more where case kind {points} end + case when regexp_matches(around, '{pii.COUNTER}') then {pii.AGAINST} else 0 end >= {pii.THRESHOLD}),
spans as (select doc_id, kind, place, start, kind || ':' || start || ':' || stop as span from base union all select doc_id, kind, place, start, kind || ':' || start || ':' || stop from added),
said as (select doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
           string_agg(span, ',' order by place, start) filter (place < {len(pii.BASE)}) as base, string_agg(span, ',' order by place, start) as spans from spans group by doc_id)
select t.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join said using (doc_id)"""


@query("op1_pii", _pii_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: base spans and those that checks and context add."""
    found = pii.find(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    base = F.filter(spans, lambda x: x["kind"].isin(*pii.BASE))

    def joined(of):
        return F.concat_ws(",", F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def number(kind):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(number, pii.BASE)
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _url_sql() -> str:
    def node(url: str) -> str:
        rest = f"substr({url}, strpos({url}, '://') + 3)"
        return (f"case when strpos({url}, '://') > 0 then translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') "
                f"|| regexp_extract({rest}, '^[^/?#]*([^#]*)', 1) end")

    quoted = {k: getattr(url_filter, k).replace("'", "''") for k in ("COMMENT", "TAG", "CANONICAL", "REFRESH", "HREF", "TARGET", "SCHEME")}
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
with recursive rules(verdict, h, p) as (values {rules}),
pg as (select page_id, {node('url')} as node, html from pages),
tag as (select a, regexp_replace(tag, '\\s', ' ', 'g') as tag from (
  select node as a, unnest(regexp_extract_all(regexp_replace(html, '{quoted["COMMENT"]}', '', 'g'), '{quoted["TAG"]}')) as tag from pg where node is not null)),
link as (select a, case when regexp_matches(tag, '{quoted["CANONICAL"]}') then regexp_extract(tag, '{quoted["HREF"]}', 1)
                        when regexp_matches(tag, '{quoted["REFRESH"]}') then regexp_extract(tag, '{quoted["TARGET"]}', 1) end as raw from tag),
full_link as (select a, replace(raw, '&amp;', '&') as link, regexp_extract(a, '^[^/?#]*') as h, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) as p from link where raw <> ''),
urls as (select a, case when regexp_matches(link, '{quoted["SCHEME"]}//') then link when regexp_matches(link, '{quoted["SCHEME"]}') then null
           when starts_with(link, '//') then ':' || link when starts_with(link, '/') then '://' || h || link
           when starts_with(link, '?') then '://' || h || p || link when link = '' or starts_with(link, '#') then null
           else '://' || h || case when p = '' then '/' else regexp_replace(p, '[^/]*$', '') end || link end as url from full_link),
edge as (select a, {node('url')} as b from urls),
both_ways as (select a, b from edge where b is not null union select b, a from edge where b is not null),
reach(a, b) as (select a, a from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
fit as (select n.node, h || p as rule, verdict, row_number() over (partition by n.node order by len(h || p) desc, verdict desc, h desc, p desc) as k
        from (select node from pg union select a from both_ways) n join rules
        on (regexp_extract(node, '^[^/?#]*') = h or ends_with(regexp_extract(node, '^[^/?#]*'), '.' || h)) and starts_with(regexp_extract(node, '^[^/?#]*([^?#]*)', 1), p)),
best as (select node, rule, verdict from fit where k = 1),
shared as (select reach.a as node, min(reach.b) as component, bool_or(coalesce(verdict, '') = 'allow') as yes, bool_or(coalesce(verdict, '') = 'block') as no from reach left join best on best.node = reach.b group by reach.a)
select page_id, coalesce(regexp_extract(pg.node, '^[^/?#]*'), '') as host, coalesce(regexp_extract(pg.node, '^[^/?#]*([^?#]*)', 1), '') as path, rule,
       coalesce(best.verdict, case when yes then 'allow' when no then 'block' end, 'allow') as verdict, component
from pg left join best on best.node = pg.node left join shared on shared.node = pg.node"""


@query("op3_url_filter", _url_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed and blocked pages, decisions shared by all aliases of a page."""
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


@query("op4_warc_archive", """
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages),
o as (select h, max(page_id) as owner from p group by h)
select page_id, cast(n as bigint) as payload_bytes, sha1(p.h) as payload_digest,
       case when n < 1000 or page_id = owner then 'response' else 'revisit' end as record_type,
       case when n < 1000 or page_id = owner then null else owner end as refers_to
from p join o on p.h = o.h""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archive records, read back from the archive."""
    folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.summary(spark, folder).withColumnRenamed("record_id", "page_id")


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every text, and whether enough of it is content."""
    found = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; learned from labelled rows that are not held out."""
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(3, "row_id") != 1)
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op11_fill_in_middle", r"""
with t as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as d from documents),
h as (select *, cast('0x' || substr(d, 1, 8) as bigint) as h1, cast('0x' || substr(d, 9, 8) as bigint) as h2, cast('0x' || substr(d, 17, 8) as bigint) as h3, cast('0x' || substr(d, 25, 8) as bigint) as h4 from t),
c as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(t) as restored_sha256
from p""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut for fill-in-middle training, and what is rebuilt from them."""
    out = fim.transform(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query("op12_context_mixing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every text; learned from the rows that are not held out."""
    found = mixing.score(table(spark, sf_dir, "documents"), remainder(5) != 1)
    held_out = F.coalesce(remainder(5) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query("op13_phrase_mining", r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
spot as (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from (select lang, w, unnest(range(1, 6)) as m from w) where len(w) >= m),
f as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f from spot group by all),
n as (select lang, cast(sum(f) as bigint) as n from f where m = 1 group by lang),
c as (select lang, phrase, m, f as a from f where m > 1 and f >= 100),
cut as (select *, array_to_string(string_split(phrase, ' ')[1:k], ' ') as first, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as rest from (select *, unnest(range(1, m)) as k from c)),
scored as (select cut.lang, cut.phrase, a, k, fl.f as l, fr.f as r, n, cast(cast(1000 as hugeint) * a * n // (cast(fl.f as hugeint) * fr.f) as bigint) as score
           from cut join f fl on fl.lang = cut.lang and fl.phrase = cut.first join f fr on fr.lang = cut.lang and fr.phrase = cut.rest join n on n.lang = cut.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (select * from best b where not exists (select 1 from c where c.lang = b.lang and c.a = b.a and len(c.phrase) > len(b.phrase) and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept)
select * from ranked where rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest word combinations of every language."""
    return phrases.mine(table(spark, sf_dir, "documents"))
