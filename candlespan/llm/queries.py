"""One query per operator over the given tables, at production parameters, and the SQL of those that SQL can state."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespan.llm import bpe, decontaminate, exact_dedup, language_model, mixing, pii, secrets, simhash, spelling, tokenize, toxicity, url_filter, vector_codes
from candlespan.sources.walk import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secrets.BASE + secrets.MORE
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), rules)
    base = F.filter("spans", lambda s: s["kind_no"] < len(secrets.BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind_no"] == i)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)],
        F.sha2(secrets.spans_text(base, rules), 256).alias("base_sha256"), secrets.spans_text(F.col("spans"), rules).alias("spans"),
    )


def vocabulary() -> str:
    """The byte-level vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.token_output(table(spark, sf_dir, "documents"), vocabulary())


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.personal_data(docs, pii.train(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def word_vocabulary() -> str:
    """The vocabulary file with word ends of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    return vector_codes.label_errors(codes).select(
        F.col("id").alias("vec_id"), vector_codes.code_text(F.col("code")).alias("code"), "error", "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_texts(table(spark, sf_dir, "documents"), word_vocabulary(), decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_output": op2_token_output,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix_sources": op4_mix_sources,
    "op5_lm_score": op5_lm_score,
    "op6_url_filter": op6_url_filter,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_personal_data": op8_personal_data,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_codes": op12_vector_codes,
    "op13_bpe_round_trip": op13_bpe_round_trip,
}

#: Places are running sums of the lengths of the pieces between matches and of the matches.
SECRETS_SQL = """
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        rules(kind_no, kind, pattern, grp, least_) AS (VALUES @@RULES@@),
        cut AS (
            SELECT doc_id, kind_no, kind, pattern, grp, least_, regexp_extract_all(text, pattern) AS hits, regexp_split_to_array(text, pattern) AS gaps
            FROM docs CROSS JOIN rules WHERE regexp_matches(text, pattern)
        ), each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM cut),
        placed AS (
            SELECT doc_id, kind_no, kind, length(hits[i]) AS size,
                coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
            FROM each WHERE length(CASE grp WHEN 2 THEN regexp_extract(hits[i], pattern, 2) ELSE hits[i] END) >= least_
        ), spans AS (
            SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
                string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, kind_no) FILTER (WHERE kind_no < 3) AS base,
                string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + size AS BIGINT), ',' ORDER BY start, kind_no) AS spans
            FROM placed GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN spans USING (doc_id)"""


def codebook_sql(entries: int = 256, parts: int = 4, rounds: int = 4, width: int = 16) -> str:
    """Every point against every entry, in doubles that hold whole numbers; one pair of tables for each round."""
    near = """
        near{r} AS MATERIALIZED (
            SELECT row, p, arg_min(e, dist * 1000 + e) AS e, CAST(min(dist) AS BIGINT) AS dist FROM (
                SELECT row, x.p, e, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS dist
                FROM points x JOIN book{r} b ON x.p = b.p) GROUP BY row, p),"""
    moved = """
        book{n} AS MATERIALIZED (
            SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
                SELECT p, e, list(mean ORDER BY i) AS c FROM (
                    SELECT n.p, n.e, i, floor(sum(v[i]) / count(*)) AS mean
                    FROM near{r} n JOIN points x ON x.row = n.row AND x.p = n.p, range(1, @width + 1) t(i) GROUP BY n.p, n.e, i)
                GROUP BY p, e) m ON m.p = b.p AND m.e = b.e),"""
    text = """
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        points AS MATERIALIZED (SELECT row, p, v[p * @width + 1:(p + 1) * @width] AS v FROM kept, range(@parts) t(p)),
        book0 AS MATERIALIZED (SELECT p, row - 1 AS e, v AS c FROM points WHERE row <= @entries),"""
    for r in range(rounds + 1):
        text += near.format(r=r) + (moved.format(r=r, n=r + 1) if r < rounds else "")
    text += """
        codes AS (SELECT row, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM near@rounds GROUP BY row),
        book AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM book@rounds, range(1, @width + 1) t(i))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (row), book"""
    for name, value in (("@entries", entries), ("@parts", parts), ("@rounds", rounds), ("@width", width)):
        text = text.replace(name, str(value))
    return text


_quoted = lambda x: "'" + x.replace("'", "''") + "'"

#: A word one letter shorter equals the longer one without some letter; words of one length, without the letter at one place.
SPELLING_SQL = r"""
        WITH RECURSIVE crc_table AS (
            SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) b(k))
        ), runs AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
            WHERE length(run) >= 6 GROUP BY ALL
        ), bytes AS (
            SELECT *, list_transform(range(CAST(length(code) / 2 AS BIGINT)), lambda i: 16 * (strpos('0123456789ABCDEF', code[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', code[2 * i + 2]) - 1) AS b
            FROM (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS code FROM runs)
        ), hashed AS (
            SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table
        ), words AS MATERIALIZED (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), less AS MATERIALIZED (
            SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
        ), pairs AS (
            SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
        ), best AS MATERIALIZED (
            SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word, n
        ), forms AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word
        ), walk AS (
            SELECT word, word AS at FROM forms
            UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.at WHERE f.form IS NOT NULL
        ), ends AS (SELECT k.word, k.at AS root FROM walk k JOIN forms f ON f.word = k.at WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""

ORACLES = {
    "op1_secret_scan": SECRETS_SQL.replace("@@RULES@@", ", ".join(
        f"({i}, {_quoted(r.kind)}, {_quoted(r.pattern)}, {r.group}, {r.least})" for i, r in enumerate(secrets.BASE + secrets.MORE)
    )),
    "op3_decontaminate": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (
                SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(10, len(w)) AS size FROM items WHERE len(w) > 0))
        ), places AS (
            SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (
                SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM windows))
        ), hits AS (SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x ON x.size = p.size AND x.gram = p.gram),
        covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op6_url_filter": r"""
        WITH parts AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), urls AS (
            SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
        ), rules(verdict, rule_host, rule_path) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                   ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        )
        SELECT page_id, host, path,
            (SELECT arg_max(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
             WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
            coalesce((SELECT arg_max(verdict, length(rule_host || rule_path)) FROM rules
             WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow') AS verdict
        FROM urls""",
    "op11_spelling_variants": SPELLING_SQL,
    "op12_vector_codes": codebook_sql(),
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
