"""The queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import backtrack_bpe, best_fit, exact_topk, jaccard_join, jump_shards, lyndon_runs, mixing, multi_index, ngram_automaton, phrase_bitmaps, ppm_language, token_files, toxicity
from threadloom.llm.workdir import Scratch


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(spark, docs, labels.where(id_crc() % 3 != 1))
    found = toxicity.score(spark, docs, model)
    return found.select("doc_id", F.coalesce(id_crc() % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted", F.size("sentences").alias("n_offending"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(read(spark, sf_dir, "embeddings"))


def op3_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_automaton.backoff_scores(spark, read(spark, sf_dir, "documents"), id_crc() % 10 == 0)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{Scratch(spark, 'token_files').base}/files"
    token_files.write_token_files(read(spark, sf_dir, "documents"), to, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, to)


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.assign(spark, read(spark, sf_dir, "documents"))


def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = ppm_language.train(spark, docs.where(id_crc() % 4 != 2))
    return ppm_language.predict(spark, docs, model).select("doc_id", F.coalesce(id_crc() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(spark, read(spark, sf_dir, "embeddings"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spark, read(spark, sf_dir, "documents"))


def op9_backtrack_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtrack_bpe.encode_decode(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), digests=True)


def op10_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(spark, docs, max_repetition=2.0)
    return mixed.select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"))


def op11_phrase_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_bitmaps.collocations(spark, read(spark, sf_dir, "documents"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit.cut_pieces(spark, read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return best_fit.place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "part", "nth"))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyndon_runs.digests(lyndon_runs.periodic_runs(spark, read(spark, sf_dir, "documents"), perturb=True))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_exact_topk, op3_backoff_automaton, op4_token_files, op5_jump_shards, op6_ppm_language, op7_multi_index, op8_jaccard_join, op9_backtrack_bpe, op10_temperature_mixing, op11_phrase_bitmaps, op12_best_fit, op13_lyndon_runs)}
#: DuckDB SQL of the operators that it can express on whole tables. The others need crc32 of texts, tokenizers or trained models.
SQL: dict[str, str] = {
    "op2_exact_topk": """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
      where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    asks as (select distinct vec_id, q from v where vec_id % 50 = 0),
    scored as (select a.vec_id as query_id, v.vec_id, list_inner_product(a.q, v.q)::bigint as score from asks a join v on v.vec_id <> a.vec_id and len(a.q) = len(v.q)),
    ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored)
    select * from ranked where rank <= 5
    """,
    "op8_jaccard_join": r"""
    with recursive docs as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    w as (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs),
    sets as (select doc_id, list_sort(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as s from w),
    classes as (select min(doc_id) as rep, s from sets where len(s) > 0 group by s),
    items as (select rep, len(s) as n, unnest(s) as x from classes),
    links as (select a.rep as a, b.rep as b from items a join items b on a.x = b.x and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      group by a.rep, b.rep, a.n, b.n having 180 * count(*) >= 80 * (a.n + b.n)),
    edges as (select a, b from links union all select b, a from links),
    reach as (select rep as a, rep as b from classes union select r.a, e.b from reach r join edges e on r.b = e.a),
    named as (select a as rep, min(b) as component_id from reach group by a)
    select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(n.component_id, s.doc_id) as component_id
    from sets s left join classes c on c.s = s.s left join named n on n.rep = c.rep
    """,
    "op11_phrase_bitmaps": r"""
    with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
    g as (select lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) as g from w),
    f as (select lang, g, count(*) as f from g group by all),
    n as (select lang, sum(f)::bigint as n from f where len(g) = 1 group by lang),
    c as (select lang, g, f as a from f where f >= 30 and len(g) > 1),
    cuts as (select lang, g, a, unnest(range(1, len(g))) as k from c),
    scores as (select c.lang, c.g, c.a, c.k, l.f as l, r.f as r, ((2000000::hugeint * c.a) // (l.f::hugeint + r.f::hugeint))::bigint as score
      from cuts c join f l on l.lang = c.lang and l.g = c.g[1:c.k] join f r on r.lang = c.lang and r.g = c.g[c.k + 1:len(c.g)]),
    lowest as (select * from scores qualify row_number() over (partition by lang, g order by score, k) = 1),
    inner_ as (select lang, a, unnest(flatten(list_transform(range(2, len(g)), lambda k: list_transform(range(1, len(g) - k + 2), lambda i: g[i:i + k - 1])))) as g from c where len(g) > 2),
    longest as (select lang, g, max(a) as f from inner_ group by all),
    named as (select x.lang, array_to_string(x.g, ' ') as phrase, x.a, x.l, x.r, x.score from lowest x left join longest y on y.lang = x.lang and y.g = x.g where y.f is null or 100 * y.f::hugeint < 80 * x.a::hugeint),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from named)
    select lang, rank, phrase, a, l, r, n, score from ranked join n using (lang) where rank <= 2000
    """,
}
