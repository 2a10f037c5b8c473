"""The registered queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, language_model, licenses, mixing, quality, simhash, toxicity, url_filters, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.lm_scores(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_exact_dedup, op3_simhash, op4_warc, op5_licenses, op6_language_model, op7_quality, op8_toxicity, op9_decontamination, op10_mixing)}


# -- SQL --------------------------------------------------------------------------------------------

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _url_sql() -> str:
    """Every rule is tried on every url, longest first: what the index must not change."""
    quote = lambda x: x.replace("'", "''").replace(r"\Z", r"\z")  # noqa: E731
    longest = lambda rules: sorted(rules, key=lambda r: (-len(r.text), r.action != "block", r.text))  # noqa: E731
    case = lambda rules, subject, value: "case " + " ".join(f"when regexp_matches({subject}, '^(?:{quote(r.regex())})') then '{value(r)}'" for r in longest(rules)) + " end"  # noqa: E731
    text, action = (lambda r: r.text), (lambda r: r.action)
    return f"""with r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest, coalesce(translate(url, '{_UPPER}', '{_LOWER}'), '') as low from pages),
    h as (select page_id, low, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from r),
    j as (select *, {case(url_filters.PLACES, "host || path", text)} as rule, {case(url_filters.PLACES, "host || path", action)} as said, {case(url_filters.PATTERNS, "low", text)} as fit from h)
    select page_id, host, path, rule, coalesce(said, case when fit is not null then 'block' else 'allow' end) as verdict, case when rule is null then fit end as pattern from j"""


_EXACT = r"""with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
  g as (select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, sha256(t) as text_sha256 from n)
  select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g"""

_WARC = """with p as (select page_id, coalesce(html, '') as h from pages), g as (select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest, max(page_id) over (partition by h) as last from p)
  select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> last then last end as refers_to from g"""

_MIXING = r"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
  s as (select source, sum(size) as source_size from d group by source),
  w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0 else 1.0 end as weight from s),
  r as (select *, 2.0::double * source_size as cap, 2.0::double * source_size / weight as ratio from w),
  l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from r),
  f as (select first(level order by ratio) as level from l where ratio >= level),
  t as (select l.source, source_size, least(cap, f.level * weight) as target from l, f),
  c as (select d.doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate,
    ('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13))::bigint / 4503599627370496.0::double as u from d join t on d.source is not distinct from t.source)
  select doc_id, size, cast(source_size as bigint) as source_size, target, cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken from c"""


def _licences_sql(how: licenses.Scan = licenses.Scan()) -> str:
    """The trained weights and the templates stand in it as values; lines are joined by windows, where the operator uses a pattern."""
    model = licenses.train(how)
    table = lambda rows: ",".join("(" + ",".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in row) + ")" for row in rows)  # noqa: E731
    names = [f"z{k}" for k in range(len(model.classes))]
    weights = table((g, *map(float, w)) for g, w in zip(model.vocabulary, model.weights, strict=True))
    templates = table((k, f"{k}-{i}", g, len(gs)) for k, ts in licenses.TEMPLATES.items() for i, t in enumerate(ts) for gs in [licenses.grams(t)] for g in gs)
    scores = ", ".join(f"sum({n}) + ({float(b)!r}) as {n}" for n, b in zip(names, model.bias, strict=True))
    total = " + ".join(f"exp({n} - top)" for n in names)
    best = f"greatest({', '.join(names[2:])})"
    family = "case " + " ".join(f"when {n} = {best} then '{k}'" for n, k in list(zip(names, model.classes, strict=True))[2:]) + " end"
    blank = r"[\x09-\x0D\x20]"
    return rf"""with weights(gram, {", ".join(names)}) as (values {weights}), templates(family, template, gram, size) as (values {templates}),
  rows as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
  lines as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from rows),
  flags as (select *, regexp_matches(regexp_replace(line, '[ 	]+$', ''), '^[^
]{{49,119}}[^	- .!?:;]$') as full_line, regexp_matches(line, '[A-Za-z0-9]') as says from lines),
  starts as (select *, case when coalesce(lag(full_line) over (partition by r order by i), false) and says then 0 else 1 end as start from flags),
  numbered as (select *, sum(start) over (partition by r order by i) - 1 as paragraph from starts),
  joined as (select r, doc_id, paragraph, string_agg(line, ' ' order by i) as body from numbered group by all having bool_or(says)),
  bodies as (select distinct doc_id, cast(paragraph as int) as paragraph, body from joined),
  words as (select *, regexp_extract_all(translate(body, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') as w from bodies),
  grams as (select doc_id, paragraph, body, list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as gs from words),
  sums as (select doc_id, paragraph, body, any_value(gs) as gs, {scores} from (select *, unnest(gs) as gram from grams) join weights using (gram) group by doc_id, paragraph, body),
  tops as (select *, greatest({", ".join(names)}) as top from sums),
  chances as (select *, {total} as total from tops),
  judged as (select *, exp(z0 - top) / total as nothing, exp({best} - top) / total as share, {family} as likeliest from chances),
  found as (select doc_id, paragraph, body, gs, case when share >= {how.sure} then likeliest else '{licenses.UNSURE}' end as family,
    round(case when share >= {how.sure} then share else 1 - nothing end, {how.digits}) as probability from judged where nothing < 0.5),
  alike as (select doc_id, paragraph, body, template, count(*) / least(any_value(len(gs)), any_value(size)) as similarity
    from (select *, unnest(gs) as gram from found) join templates using (family, gram) group by doc_id, paragraph, body, template),
  best as (select doc_id, paragraph, body, max(row(similarity, template)) as m from alike group by doc_id, paragraph, body)
  select f.doc_id, f.paragraph, family, probability, m[2] as template, m[1] as similarity, coalesce(m[1] >= {how.alike}, false) as confirmed
  from found f left join best b on f.doc_id is not distinct from b.doc_id and f.paragraph = b.paragraph and f.body = b.body"""


def oracle_sql() -> dict[str, str]:
    """Fingerprints (no XXH64 there), scores of models that learn from the tables, and tiles can't be said in DuckDB's SQL; their tests use brute force."""
    return {"op1_url_filters": _url_sql(), "op2_exact_dedup": _EXACT, "op4_warc": _WARC, "op5_licenses": _licences_sql(), "op10_mixing": _MIXING}
