"""One query per operator, with the parameters used in production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact, language, licenses, mixing, multi_index, multiset, packing, pii, repeats, simhash, suffix, whitening
from .common import kept, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no path: a source is a repository, its directories hold a thousand and a hundred ids."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id")
    path = F.concat_ws("/", "source", F.floor(number / 1000).cast("string"), F.floor(number / 100).cast("string"), number.cast("string"))
    found = licenses.scan(docs.select("doc_id", "text", path.alias("path")), with_text=False)
    return found.select("doc_id", "path", "license", F.round("license_score", 9).alias("license_score"), "license_from", "license_dir")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(~language.held_out()))
    named = language.identify(docs.select("doc_id", "text"), model)
    return named.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op4_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprints(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    # Sizes are asked for four times; counted once, they are a few bytes a row.
    found = mixing.taken_words(*mixing.mix(kept(sized)))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    names = F.array(*[F.lit(k) for k in pii.KINDS])

    def joined(spans):
        parts = F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
        )
        return F.array_join(parts, ",")

    def count(number, kind):
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")

    counts = [count(number, kind) for number, kind in enumerate(pii.KINDS)]
    everything = F.array_sort(F.concat("base", "added"))
    return found.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(everything).alias("spans")
    )


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(df)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.variances]).cast("array<double>")
    found = whitening.whiten(df, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.centre.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark(table(spark, sf_dir, "documents"))


QUERIES = {"op1_packing": op1_packing, "op2_licenses": op2_licenses, "op3_language": op3_language, "op4_multiset": op4_multiset, "op5_mixing": op5_mixing, "op6_simhash": op6_simhash, "op7_suffix": op7_suffix, "op8_pii": op8_pii, "op9_repeats": op9_repeats, "op10_multi_index": op10_multi_index, "op11_divergence": op11_divergence, "op12_whitening": op12_whitening, "op13_exact": op13_exact}
# Every window is listed here, which only small tables allow.  The other operators are tested by brute force.
ORACLES = {
    "op9_repeats": r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, ws, unnest(range(1, len(ws) - 33)) as pos from d where len(ws) >= 35),
f as (select doc_id, pos, count(*) over (partition by array_to_string(ws[pos:pos + 34], ' ')) as n from s),
gone as (select distinct doc_id, unnest(range(pos, pos + 35)) as pos from f where n > 1),
removed as (select doc_id, count(*) as n_removed from gone group by doc_id),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from d),
left_ as (select doc_id, string_agg(word, ' ' order by pos) as k from words anti join gone using (doc_id, pos) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256
from d left join removed using (doc_id) left join left_ using (doc_id)""",
    # Every term meets every pair of sources.
    "op11_divergence": r"""with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
o as (select lang, source, doc, unnest(ts) as term from d),
t as (select lang, term, count(*) as total from o group by all having count(distinct doc) >= 3),
l as (select lang, count(*) as v, sum(total) as lang_n from t group by lang),
g0 as (select distinct lang, source from d),
c0 as (select lang, source, term, count(*) as c from o semi join t using (lang, term) group by all),
n0 as (select lang, source, sum(c) as n from c0 group by all),
g as (select lang, source, coalesce(n, 0) as n, v, lang_n from g0 left join n0 using (lang, source) join l using (lang)),
p as (select g.lang, g.source, t.term, coalesce(c, 0) as c, total, lang_n, v,
 1 + cast(1000000000 * (cast(coalesce(c, 0) as hugeint) + 1) // cast(n + v as hugeint) as bigint) as p
 from g join t using (lang) left join c0 on c0.lang = g.lang and c0.source = g.source and c0.term = t.term),
pv as (select a.lang, a.source, b.source as item, cast(sum((a.p - b.p) * (a.p - b.p) // b.p) as bigint) as value
 from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g0 a
 join g0 b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
q as (select *, 1 + cast(1000000000 * (cast(total as hugeint) + 1) // cast(lang_n + v as hugeint) as bigint) as q from p where c > 0),
terms as (select lang, source, 'term' as part, term as item, cast((p - q) * (p - q) // q as bigint) as value from q where p > q),
r as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
 from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 200""",
    "op13_exact": r"""with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
 doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d""",
}
