"""The queries of the text operators: each over its whole table, with production parameters, and SQL beside four of them.

The SQL knows nothing of triggers, bands, hash sets or chunks: it compares all strings of 200 bytes, all pairs of sets that share a
shingle, all windows of words, and all windows of lines, and takes rows with one id for one document."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_dir
from . import byte_bpe, collocations, decontaminate, fingerprints, hard_negatives, html_text, language_id, licenses, line_dedup, near_dup, repeats, token_counts, token_files
from .decontaminate import LOWER, UPPER

PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents"), length=200, with_kept=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10).drop("key")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_limit(token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")), 2048)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate(table(spark, sf_dir, "documents"), windows=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file below its source and language."""
    docs = table(spark, sf_dir, "documents")
    files = docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return licenses.scan(files, keep=("doc_id",))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), most_words=3, least=10, cover=50, top=2000)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has the next label; anchors are the rows whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label, positives=5, negatives=5, least=80, scale=256)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{run_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), at, end=0)
    return token_files.summaries(spark, at)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_decontamination, op4_near_dedup, op5_token_counts, op6_line_dedup, op7_byte_bpe, op8_fingerprints, op9_license_scan, op10_html_extraction, op11_collocations, op12_hard_negatives, op13_token_files, pipeline)}

OP1_SQL = """with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
 x as (select r, j, substr(h, 1 + 2 * j, 2 * (1024 + 199)) as h from (select r, h, unnest(range(0, n - 199, 1024)) as j from d where n >= 200)),
 s as (select r, j, unnest(range(0, strlen(h) // 2 - 199)) as i, h from x), k as (select r, j + i as i, md5_number(substr(h, 1 + 2 * i, 400)) as m from s), again as (select m from k group by m having count(*) > 1),
 c as (select r, i, lag(i) over w as before, lead(i) over w as after from k semi join again using (m) window w as (partition by r order by i)),
 o as (select r, sum(least(200, coalesce(after - i, 200))) n_removed, count(*) filter (where before is null or i > before + 200) n_spans from c group by r),
 e as (select r, i, case when before is null or i > before + 200 then coalesce(before + 200, 0) end as a, case when after is null then i + 200 end as z from c),
 g as (select r, a, i as b from e where a is not null union all select e.r, z, n from e join d on d.r = e.r where z is not null),
 p as (select g.r, string_agg(substr(h, 1 + 2 * a, 2 * (b - a)), '' order by a) as kept from g join d on d.r = g.r group by g.r)
 select doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256 from d left join o on o.r = d.r left join p on p.r = d.r"""
OP3_SQL = f"""with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
 b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
 v as (select item, least(len(w), 10) k, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i, w from b where len(w) > 0), t as (select distinct item, k, array_to_string(w[i : i + k - 1], ' ') as t from v),
 u as (select doc_id, k, unnest(range(1, len(w) - k + 2)) as i, w from w, (select distinct k from t) where len(w) >= k), x as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as t from u),
 f as (select doc_id, i, k, item from x join t using (k, t)), h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from f) group by 1), j as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from f) group by 1)
 select w.doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from w left join h on h.doc_id = w.doc_id left join j on j.doc_id = w.doc_id"""
OP4_SQL = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') as w from documents),
 s as (select distinct doc_id, case when len(w) = 1 then w[1] else w[i] || ' ' || w[i + 1] end as s from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as i from w where len(w) > 0)),
 n as (select doc_id, count(*) as n from s group by 1), g as (select doc_id, md5_number(string_agg(s, chr(0) order by s)) as g from s group by 1), r as (select g, min(doc_id) as doc_id from g group by 1),
 q as (select s.doc_id, s.s from s semi join r on r.doc_id = s.doc_id), c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from q a join q b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
 e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)), l as (select a, b from e union all select b, a from e),
 t as (select doc_id as a, doc_id as b from r union select t.a, l.b from t join l on l.a = t.b), m as (select a, min(b) as least from t group by 1)
 select w.doc_id, coalesce(n.n, 0) n_shingles, coalesce(m.least, w.doc_id) component_id, coalesce(m.least, w.doc_id) = w.doc_id kept from w left join n on n.doc_id = w.doc_id left join g on g.doc_id = w.doc_id left join r on r.g = g.g left join m on m.a = r.doc_id"""
OP6_SQL = """with t as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as x from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)),
 b as (select *, lead(x) over (partition by doc_id order by i) as y from t),
 v as (select doc_id, i, 2 as n, x || chr(10) || y as body from b where y is not null and regexp_matches(x || y, '[^ \\t\\n\\x0B\\f\\r]') union all select doc_id, i, 1, x from b where len(regexp_extract_all(x, '[^ \\t\\n\\x0B\\f\\r]+')) >= 50),
 f as (select n, body, min((doc_id, i)) as f from v group by 1, 2 having count(*) > 1), o as (select distinct doc_id, unnest(range(i, i + n)) as i from v join f using (n, body) where doc_id <> f[1] or i >= f[2] + n),
 k as (select t.doc_id, count(*) n_lines, count(o.i) n_removed, coalesce(string_agg(x, chr(10) order by t.i) filter (where o.i is null), '') as kept from t left join o on o.doc_id = t.doc_id and o.i = t.i group by 1)
 select d.doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from documents d left join k on k.doc_id = d.doc_id"""

OP11_SQL = f"""with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as p from documents),
 w as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from p), g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) as g from w, (values (1), (2), (3)) s(k) where len(w) >= k),
 f as (select lang, k, g, count(*) as f from g group by all), n as (select lang, sum(f)::bigint as n from f where k = 1 group by 1), c as (select lang, k, g, f as a, unnest(range(1, k)) as cut from f where k > 1 and f >= 10),
 s as (select c.lang, c.k, c.g, a, cut, x.f as l, y.f as r, (1000000 * a::hugeint * a // (x.f::hugeint * y.f))::bigint as score from c join f x on x.lang = c.lang and x.g = c.g[:cut] join f y on y.lang = c.lang and y.g = c.g[cut + 1 :]),
 b as (select lang, k, g, a, l, r, score from s qualify row_number() over (partition by lang, g order by score, cut) = 1),
 d as (select lang, k, g, a, l, r, score from b where not exists (select 1 from f where f.lang = b.lang and f.k = 3 and b.k = 2 and f.f >= 10 and 100 * f.f >= 50 * b.a and (f.g[1:2] = b.g or f.g[2:3] = b.g)))
 select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') as phrase, a, l, r, n, score from d join n using (lang) qualify rank <= 2000"""

OP12_SQL = """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
 p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
 select anchor_id, positive_id, (row_number() over w)::int as rank, vec_id as negative_id, positive_score, score as negative_score from p join s using (anchor_id)
  where not same and 80 * positive_score <= 100 * score and score <= positive_score window w as (partition by anchor_id, positive_id order by score desc, vec_id) qualify rank <= 5"""

ORACLES: dict[str, str] = {"op11_collocations": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op1_suffix_dedup": OP1_SQL, "op3_decontamination": OP3_SQL, "op4_near_dedup": OP4_SQL, "op6_line_dedup": OP6_SQL}
