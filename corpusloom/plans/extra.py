"""More of the registry: sinks that are read back, models, dictionaries, segmenters and the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import filters as f, hashing as h, ngrams as g, normalize as n, similarity as m
from corpusloom.operators import dedup, dialogue, minhash, scoring, substring, vocab
from corpusloom.plans.ordering import numbered
from corpusloom.plans.queries import _MERGED_WORDS, KEYS, ORACLES, SIGNATURE, SIGS, SPACE_WORDS, T, column, query, read
from corpusloom.plans.storage import Stash, once, scratch_path, spread
from corpusloom.sources import text as src

WORDS = SPACE_WORDS.format("text")
LOWER = SPACE_WORDS.format("lower(text)")

# -- language models -------------------------------------------------------------------------------------------------
_FRAMED = lambda table: f"SELECT ['<s>'] || {LOWER} || ['</s>'] AS w FROM {table}"
_COUNTED = lambda table, k: f"SELECT {k} AS n, array_to_string(w[i:i + {k - 1}], ' ') AS gram, count(*) AS count FROM (SELECT w, unnest(range(1, len(w) - {k} + 2)) AS i FROM ({_FRAMED(table)})) GROUP BY ALL"
LOWERED = lambda df: df.withColumn("text", F.lower("text"))
query("a13_ngram_counts", "documents", " UNION ALL ".join(_COUNTED("documents", k) for k in (1, 2, 3)))(lambda df: scoring.ngram_counts(LOWERED(spread(df)), 3))
# Stupid back-off of order 3, learnt from the benchmark items, so that most words of the documents back off.
_LEVEL = "CASE WHEN c3 IS NOT NULL THEN log10(c3 / b2) WHEN c2 IS NOT NULL THEN log10(c2 / b1) + d3 * log10(0.4) ELSE log10(coalesce(c1, 0.5) / total) + (1 + d3) * log10(0.4) END"
query("a9_backoff_perplexity", None, f"""WITH m AS ({" UNION ALL ".join(_COUNTED("benchmark", k) for k in (1, 2, 3))}), u AS (SELECT sum(count) AS total FROM m WHERE n = 1 AND gram <> '<s>'),
    d AS (SELECT doc_id, ['<s>'] || {LOWER} || ['</s>'] AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM d),
    t AS (SELECT doc_id, w[i] AS g1, w[i - 1] AS h1, w[i - 1] || ' ' || w[i] AS g2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS h2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS g3, CASE WHEN i > 2 THEN 1 ELSE 0 END AS d3 FROM p),
    s AS (SELECT doc_id, {_LEVEL} AS s FROM (SELECT t.doc_id, d3, m3.count AS c3, m2.count AS c2, m1.count AS c1, b2.count AS b2, b1.count AS b1, total FROM t, u LEFT JOIN m m3 ON m3.gram = g3 AND m3.n = 3 LEFT JOIN m m2 ON m2.gram = g2 AND m2.n = 2 LEFT JOIN m m1 ON m1.gram = g1 AND m1.n = 1 LEFT JOIN m b2 ON b2.gram = h2 AND b2.n = 2 LEFT JOIN m b1 ON b1.gram = h1 AND b1.n = 1))
    SELECT doc_id, count(*) AS tokens, round(sum(s), 6) AS log10_score FROM s GROUP BY doc_id""")(
    lambda spark, d: scoring.backoff_scores(LOWERED(read(spark, d, "documents")), Stash(scoring.ngram_counts(LOWERED(read(spark, d, "benchmark")), 3), "model").df, 3).select("doc_id", "tokens", F.round("log10_score", 6).alias("log10_score"))
)

# -- dictionaries, sentences, segmenters -----------------------------------------------------------------------------
DICTIONARY = [("toxic", "idiot"), ("toxic", "scum"), ("toxic", "trash"), ("legal", "License"), ("legal", "Copyright"), ("common", "the")]
query("f16_dictionary_counts", None, " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, n FROM (SELECT doc_id, ({' + '.join(f'''(length(text) - length(replace(text, '{w}', ''))) // {len(w)}''' for k, w in DICTIONARY if k == c)})::BIGINT AS n FROM documents) WHERE n > 0" for c in ("toxic", "legal", "common")))(
    lambda spark, d: f.dictionary_counts(read(spark, d, "documents"), spark.createDataFrame(DICTIONARY, "category string, word string"))
)
PARTICLES, VERBS = ["of", "to", "in", "de", "der"], ["is", "was", "are", "ist", "est"]


def word_tags(text: str) -> list[tuple[str, str]]:
    """A stand-in for a tagger: a few words count as case particles or verbs, all others as nouns."""
    return [(f.PARTICLE, f.CASE_PARTICLE) if w in PARTICLES else (f.VERB, "") if w in VERBS else ("名詞", "") for w in text.split()]


_LISTED = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
query("f7_sentence_check", "documents", f"SELECT doc_id FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(list_filter(w, lambda x: NOT list_contains({_LISTED(PARTICLES)}, x))) > 0 AND len(list_filter(w, lambda x: list_contains({_LISTED(PARTICLES + VERBS)}, x))) > 0")(
    lambda df: once(spread(df), "t", f.tag_lines(word_tags)("text"), "doc_id", "text").where(f.is_sentence(F.col("t.tag"), F.col("t.detail"), T())).select("doc_id")
)
query("t14_script_runs", "documents", f"WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{g.SCRIPT_RUNS_RE2}')) AS x FROM documents) SELECT doc_id, count(*) AS n, count(DISTINCT x) AS n_distinct, max(length(x))::BIGINT AS longest FROM r GROUP BY doc_id")(
    lambda df: df.select("doc_id", F.explode(g.script_runs(T())).alias("x")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("x").alias("n_distinct"), F.max(F.length("x")).cast("long").alias("longest"))
)
query("t14_segmented", "documents", f"SELECT doc_id, len({WORDS})::BIGINT AS n, md5(array_to_string({WORDS}, '|')) AS value FROM documents")(lambda df: spread(df).select("doc_id", g.segmented(str.split)("text").alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "|")).alias("value")))
_OLD = {"é": "e", "ü": "u", "ß": "ss", "ç": "c", "ê": "e"}
column("n19_map_variants", lambda: F.md5(n.map_variants(T(), _OLD)), "md5(replace(translate(text, 'éüçê', 'euce'), 'ß', 'ss'))")

# -- vocabularies ----------------------------------------------------------------------------------------------------
_SYMBOLS = lambda df: df.select(F.explode(F.array_distinct(F.split(F.regexp_replace("text", r"[\x00-\x7F]", ""), ""))).alias("token")).where("token != ''").distinct()
query("t13_vocab_with_symbols", None, f"WITH b AS ({_MERGED_WORDS}), e AS (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'), '')) AS token FROM documents), n AS (SELECT token, row_number() OVER (ORDER BY token) AS n FROM e WHERE token <> '' AND token NOT IN (SELECT token FROM b)), f AS (SELECT i AS id, row_number() OVER (ORDER BY i) AS n FROM range(1024, 65530) t(i) WHERE i NOT IN (SELECT id FROM b)) SELECT token, id FROM b UNION ALL SELECT token, f.id::BIGINT FROM n JOIN f USING (n)")(
    lambda spark, d: vocab.merge_vocab(numbered(vocab.word_tokens(read(spark, d, "benchmark")), ["token"], "id", 1024), _SYMBOLS(read(spark, d, "documents")))
)


@query("t12_longest_match", None)
def _longest_match(spark, d) -> DataFrame:
    words = numbered(vocab.word_tokens(read(spark, d, "benchmark")), ["token"], "id", 1024)
    rows = [(r.token, r.id) for r in scoring.first_rows(words, 65_536 - 1024, ["token"]).collect()]  # ids end at 65,535
    coded = once(spread(read(spark, d, "documents")), "ids", vocab.encode_udf(rows)("text"), "doc_id", "text")
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join("ids", " ")).alias("value"), (vocab.decode_udf(rows)("ids") == F.col("text")).alias("same"))


# -- hashes and signatures -------------------------------------------------------------------------------------------
query("h4_hash_switch", "documents", "SELECT doc_id, 'md5' AS name, md5(text) AS value FROM documents UNION ALL SELECT doc_id, 'sha1', sha1(text) FROM documents UNION ALL SELECT doc_id, 'sha256', sha256(text) FROM documents")(
    lambda df: df.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), h.hash_column(k)(T()).alias("value")) for k in ("md5", "sha1", "sha256")])))
)
query("h18_presets", None, "SELECT name, bands, rows FROM (VALUES ('450', 20, 450), ('40', 20, 40), ('10', 20, 10)) t(name, bands, rows)")(lambda spark, d: spark.createDataFrame([(str(r), b, r) for b, r in h.PRESETS], "name string, bands int, rows int"))
query("h13_char_minhash", "documents")(lambda df: spread(df).select("doc_id", F.md5(F.concat_ws(",", minhash.char_signature(T()).cast("array<string>"))).alias("value")))
query("h23_packed_signatures", "documents", f"WITH {SIGS} SELECT doc_id, 32::BIGINT AS n, sum(m)::BIGINT AS total FROM s GROUP BY doc_id")(
    lambda df: once(spread(df), "s", minhash.unpack_signature(minhash.pack_signature(SIGNATURE())), "doc_id").where("s is not null").select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
)

# -- similarities of whole texts: the words of a text against those of its lower-cased form ----------------------------
_BOTH = "len(list_intersect(x, y))"
query("m_text_set_similarities", "documents", f"SELECT doc_id, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE {_BOTH} / (len(x) + len(y) - {_BOTH}) END, 9) AS jaccard, round(CASE WHEN len(x) = 0 THEN 1.0 ELSE {_BOTH} / len(x) END, 9) AS containment, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE 2.0 * {_BOTH} / (len(x) + len(y)) END, 9) AS dice FROM (SELECT doc_id, list_distinct({WORDS}) AS x, list_distinct({LOWER}) AS y FROM documents)")(
    lambda df: df.select("doc_id", F.array_distinct(g.whitespace_words(T())).alias("x"), F.array_distinct(g.whitespace_words(F.lower("text"))).alias("y")).select(
        "doc_id", F.round(m.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"), F.round(m.containment(F.col("x"), F.col("y")), 9).alias("containment"), F.round(m.dice(F.col("x"), F.col("y")), 9).alias("dice")
    )
)

# -- substrings, lists -----------------------------------------------------------------------------------------------
query("dp_positions", "documents", "SELECT doc_id, len(p)::BIGINT AS n, coalesce(list_sum(p), 0)::BIGINT AS total FROM (SELECT doc_id, list_filter(range(1, length(text)), lambda i: substring(text, i, 3) = 'the') AS p FROM documents)")(
    lambda df: df.select("doc_id", substring.positions(T(), "the").alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
)
query("j10_duplicates_by_file", "documents", f"WITH RECURSIVE z AS (SELECT * FROM ({ORACLES['dr_drop_list']})) SELECT source, count(*) AS n_rows, list(doc_id ORDER BY doc_id)::VARCHAR AS rows FROM documents WHERE doc_id IN (SELECT id FROM z) GROUP BY source".replace("WITH RECURSIVE z AS (SELECT * FROM (WITH RECURSIVE", "WITH z AS (SELECT * FROM (WITH RECURSIVE"))(
    lambda df: dedup.duplicates_by_file(dedup.components_to_drop(minhash.star_edges(KEYS(df))), df.select("doc_id", "source", F.col("doc_id").alias("row"))).select("source", "n_rows", F.concat(F.lit("["), F.array_join("rows", ", "), F.lit("]")).alias("rows"))
)

# -- sinks, read back ------------------------------------------------------------------------------------------------


@query("s8_json_lines", "documents", "SELECT doc_id, md5(replace(text, '\\n', chr(10))) AS value FROM documents")
def _json_lines(df: DataFrame) -> DataFrame:
    folder = scratch_path(df.sparkSession, "jsonl")
    paths = src.write_zstd_json_lines(spread(df).select("doc_id", "text"), folder, per_file=500)
    back = src.read_indexed(df.sparkSession, paths, 0, len(paths), "doc_id long, text string")
    return back.select("doc_id", F.md5("text").alias("value"))


@query("s20_binned_files", "documents", f"WITH b AS ({ORACLES['o2_score_bins']}) SELECT bin::INTEGER AS chunk, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM b JOIN documents USING (doc_id) GROUP BY bin")
def _binned(df: DataFrame) -> DataFrame:
    folder = scratch_path(df.sparkSession, "bins")
    edges = scoring.bin_edges(df, "n_chars")
    src.write_bins(df.select("doc_id", "n_chars", scoring.assign_bin(F.col("n_chars").cast("double"), edges).cast("int").alias("chunk")), folder, order="n_chars")
    return df.sparkSession.read.parquet(folder).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("s22_pair_lines", "documents", f"WITH {SIGS} SELECT DISTINCT id AS src, first AS dst FROM (SELECT id, min(id) OVER (PARTITION BY band, key) AS first FROM k) WHERE id <> first")
def _pairs(df: DataFrame) -> DataFrame:
    folder = scratch_path(df.sparkSession, "pairs")
    src.write_pairs(minhash.star_edges(KEYS(df)), folder)
    return src.read_pairs(df.sparkSession, folder).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query("s23_signature_table", "documents", f"WITH {SIGS}, z AS (SELECT doc_id, sum(m)::BIGINT AS total FROM s GROUP BY doc_id), t AS ({ORACLES['da_minhash_flags']}) SELECT t.id AS doc_id, total, duplicate FROM t LEFT JOIN z ON z.doc_id = t.id")
def _signature_table(df: DataFrame) -> DataFrame:
    folder = scratch_path(df.sparkSession, "signatures")
    minhash.write_signatures(spread(df).select("doc_id", SIGNATURE().alias("signature")), minhash.flags(KEYS(df), ids=df.select("doc_id")).withColumnRenamed("id", "doc_id"), folder)
    back = minhash.read_signatures(df.sparkSession, folder)
    return back.select("doc_id", F.aggregate("signature", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), "duplicate")


@query("s24_packed_tokens", "documents", f"SELECT count(*) AS n_blocks, sum(total)::BIGINT AS total FROM ({ORACLES['t19_token_blocks']})")
def _packed(df: DataFrame) -> DataFrame:
    tokens = df.select("doc_id", (F.col("doc_id") % 4).alias("batch"), F.transform(g.whitespace_words(T()), lambda x: F.length(x).cast("long")).alias("tokens"))
    files = src.write_packed_tokens(dialogue.token_blocks(tokens, 128), scratch_path(df.sparkSession, "packed"), 128, "i4", blocks_per_file=1000)
    back = src.read_packed_tokens(df.sparkSession, files, 128)
    return back.agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


# -- samples and splits ----------------------------------------------------------------------------------------------
query("o5_first_rows", "documents", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")(lambda df: scoring.first_rows(df.select("doc_id"), 100, ["doc_id"]))
query("o7_sized_split", "documents", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) <= 100 THEN 'eval' ELSE 'train' END AS part FROM documents")(
    lambda df: (lambda train, held: train.select("doc_id", F.lit("train").alias("part")).union(held.select("doc_id", F.lit("eval").alias("part"))))(*scoring.sized_split(df.select("doc_id"), 100))
)
