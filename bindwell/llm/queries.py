"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindwell.llm.chat import format_conversations, read_back
from bindwell.llm.decontam import decontaminate
from bindwell.llm.dedup_exact import exact_dedup
from bindwell.llm.html_text import extract_text
from bindwell.llm.jaccard import jaccard_join
from bindwell.llm.langid import identify, train
from bindwell.llm.license_scan import scan_licenses
from bindwell.llm.line_dedup import line_dedup
from bindwell.llm.packing import pack
from bindwell.llm.phrases import mine_phrases
from bindwell.llm.runs import find_runs
from bindwell.llm.substring import substring_dedup
from bindwell.llm.tokenbin import token_file_digest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no model learns from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs, ~F.coalesce(held_out(), F.lit(False)))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), slice_bytes=6 << 20)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return read_back(format_conversations(turns.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licenses(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    first = F.transform(base, lambda s: s["first_word"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        labels(base).alias("base_labels"),
        labels("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), slice_bytes=6 << 20)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def with_tail_repeated(docs: DataFrame) -> DataFrame:
    """The contract's texts: of one in ten, by the hash of the id, the words from some place on repeat a unit that begins there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int"))), 1, (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice(words, 1, a.cast("int")), tail), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_tail_repeated(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = found.withColumn("best", best)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_chat_format": op4_chat_format,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_token_planes": op7_token_planes,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_html_extraction": op12_html_extraction,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op3_ngram_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select distinct doc_id, array_to_string(words[i : i + least(5, len(words)) - 1], ' ') as s
  from (select doc_id, words, unnest(range(1, len(words) - least(5, len(words)) + 2)) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
r(doc_id, reach) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.reach = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.reach) as component_id
from documents d join r using (doc_id) left join n using (doc_id) group by d.doc_id, n.n""",
    "op5_exact_dedup": r"""
with t as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select norm, first(doc_id order by length(text) desc, doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256 from t join g using (norm)""",
    "op9_substring_dedup": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
k as (select doc_id, i, array_to_string(words[i : i + 12], ' ') as win from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w where len(words) >= 13)),
f as (select win, min(doc_id) as least from k group by win),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as i from k join f using (win) where least < doc_id),
n as (select doc_id, count(*) as n_removed from gone group by doc_id),
u as (select doc_id, unnest(range(1, len(words) + 1)) as i, unnest(words) as word from w),
kept as (select doc_id, string_agg(word, ' ' order by i) as kept from u anti join gone using (doc_id, i) group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join n using (doc_id) left join kept using (doc_id)""",
    "op10_decontamination": r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
bw as (select distinct item_id, least(13, len(words)) as m, array_to_string(words[i : i + least(13, len(words)) - 1], ' ') as win
  from (select item_id, words, unnest(range(1, len(words) - least(13, len(words)) + 2)) as i from b where len(words) > 0)),
sizes as (select distinct m from bw),
dw as (select doc_id, m, i, array_to_string(words[i : i + m - 1], ' ') as win
  from (select doc_id, words, m, unnest(range(1, len(words) - m + 2)) as i from w, sizes where len(words) >= m)),
hit as (select doc_id, item_id, i, dw.m from dw join bw on dw.win = bw.win and dw.m = bw.m),
spots as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + m)) as k from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from w left join spots using (doc_id) left join items using (doc_id)""",
    "op11_phrase_mining": r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
g as (select lang, m, array_to_string(words[i : i + m - 1], ' ') as phrase from (select lang, words, m, unnest(range(1, len(words) - m + 2)) as i from w, (values (1), (2), (3)) as sizes(m) where len(words) >= m)),
f as materialized (select lang, m, phrase, count(*) as a from g group by all),
n as (select lang, cast(sum(a) as bigint) as n from f where m = 1 group by lang),
c as materialized (select *, string_split(phrase, ' ') as ws from f where m > 1 and a >= 10),
ends as (select lang, phrase, a, k, array_to_string(ws[1:k], ' ') as pl, array_to_string(ws[k + 1:], ' ') as pr from (select *, unnest(range(1, m)) as k from c)),
cut as (select e.lang, e.phrase, e.a, k, l.a as l, r.a as r, cast((1000000::hugeint * e.a * e.a) // (l.a::hugeint * r.a) as bigint) as score
  from ends e join f l on l.lang = e.lang and l.phrase = pl join f r on r.lang = e.lang and r.phrase = pr),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inside as (select lang, array_to_string(ws[i : i + 1], ' ') as phrase, max(a) as longer from (select *, unnest(range(1, 3)) as i from c where m = 3) group by all),
kept as (select best.* from best left join inside using (lang, phrase) where longer is null or 100 * longer < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join n using (lang) qualify rank <= 2000""",
}
