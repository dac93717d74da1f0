"""The registered queries of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chatfmt, hostgraph, html_extract, langid, minhash, packing, repetition, suffix_dedup, topk
from .common import table

#: Where the public vocabulary files lie; a parameter of the operators.
WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by 2-word shingles at 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition rules on all documents."""
    return repetition.judged(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and round-trip digests of all documents."""
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that stand earlier, removed from all documents."""
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op5_block_max_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector."""
    return topk.best_matches(table(spark, sf_dir, "embeddings"))


def op6_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op7_host_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return hostgraph.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return langid.identified(table(spark, sf_dir, "documents"))


def op9_incremental_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back, and one that consists of control strings."""
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chatfmt.formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted), turn_local=True)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_suffix_repetition, op3_bpe_codec, op4_suffix_array_dedup, op5_block_max_topk, op6_tag_path_ratios, op7_host_graph, op8_kneser_ney_langid, op9_incremental_chat_format, op10_best_fit_packing)}
#: Words of a text in SQL.
WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

NEAR_DUPLICATES = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.size + y.size - common)),
    reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    roots AS (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY 1)
    SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN roots ON roots.doc_id = d.doc_id"""

#: The longest repeat is over its limits if a run of words just over them, and of 8 at least, comes up twice.
REPETITION = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, {WORDS.format("t")} AS ws FROM d),
    x AS (SELECT *, len(ws) AS n, greatest(8, least({{most}}, {{percent}} * len(ws) // 100) + 1) AS m FROM w),
    eights AS (SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS k FROM (SELECT r, ws, unnest(range(1, n - 6)) AS i FROM x)),
    again AS (SELECT r, i FROM eights QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
    places AS (SELECT DISTINCT r, i + j AS p FROM again, range(8) o(j)),
    covered AS (SELECT r, count(*) AS words, sum(length(ws[p])) AS chars FROM places JOIN x USING (r) GROUP BY 1),
    longs AS (SELECT DISTINCT r FROM (SELECT r, array_to_string(ws[i : i + m - 1], ' ') AS k FROM (SELECT r, ws, m, unnest(range(1, n - m + 2)) AS i FROM x)) GROUP BY r, k HAVING count(*) > 1),
    lines AS (SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS again FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM x) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
    j AS (SELECT x.*, coalesce(c.words, 0) AS n_repeat_words, CAST(coalesce(c.chars, 0) AS BIGINT) AS repeat_chars, coalesce(l.again, 0) AS n_dup_lines, g.r IS NOT NULL AS long,
                 CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars
          FROM x LEFT JOIN covered c ON c.r = x.r LEFT JOIN lines l ON l.r = x.r LEFT JOIN longs g ON g.r = x.r)
    SELECT doc_id, n AS n_words, word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, repeat_chars,
           n < 20 OR 100 * n_repeat_words > 30 * n AS base_failed, NOT (n < 20 OR 100 * n_repeat_words > 30 * n) AND 100 * repeat_chars <= {{chars}} * word_chars AND NOT long AS kept
    FROM j""".format(most=100, percent=repetition.MAX_LONGEST_PERCENT, chars=repetition.MAX_PERCENT)

#: Bytes as two hexadecimal digits each; windows by a 64-bit hash.
PASSAGES = """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)),
    m AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
    g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS span
          FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM m)),
    spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY 1, 2),
    gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT s.doc_id, max(b), max(len(h)) // 2 FROM spans s JOIN d USING (doc_id) GROUP BY 1),
    kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY 1),
    sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n FROM spans GROUP BY 1)
    SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
    FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _url_sql(rounds: int = 20) -> str:
    """Rules, then ranks along links after so many rounds; hosts of the graph without user and port."""
    rules = [(v, h, p) for v, h, p in sorted(hostgraph.RULES, key=lambda r: -len(r[1] + r[2]))]
    fits = lambda c, h: f"({c} = '{h}' OR ends_with({c}, '.{h}'))"
    first = lambda k: "CASE " + " ".join(f"WHEN {fits('host', h)} AND starts_with(path, '{p}') THEN '{(h + p, v)[k]}'" for v, h, p in rules) + " END"
    any_of = lambda which: "(" + (" OR ".join(fits("host", h) for v, h, p in rules if which(v, p)) or "FALSE") + ")"
    bare = lambda c: f"regexp_replace({c}, '^[^@]*@|:[0-9]*$', '', 'g')"
    ranks = "".join(
        f"""
    t{k} AS MATERIALIZED (SELECT l.dst AS host, sum(l.n / l.out_n * r.t) AS f FROM links l JOIN r{k} r ON r.host = l.src GROUP BY 1),
    d{k} AS MATERIALIZED (SELECT l.src AS host, sum(l.n / l.in_n * r.d) AS f FROM links l JOIN r{k} r ON r.host = l.dst GROUP BY 1),
    r{k + 1} AS MATERIALIZED (SELECT x.host, st, sd, 0.15 * st + 0.85 * coalesce(a.f, 0) AS t, 0.15 * sd + 0.85 * coalesce(b.f, 0) AS d FROM r{k} x LEFT JOIN t{k} a ON a.host = x.host LEFT JOIN d{k} b ON b.host = x.host),"""
        for k in range(rounds)
    )
    letters = f"'{hostgraph.UPPER}', '{hostgraph.LOWER}'"
    return rf"""
    WITH u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {letters}) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    raw AS (SELECT {bare("host")} AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)) AS dst FROM u),
    edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, translate({bare("dst")}, {letters}) AS dst FROM raw) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
    links AS (SELECT *, sum(n) OVER (PARTITION BY src) AS out_n, sum(n) OVER (PARTITION BY dst) AS in_n FROM edges),
    known AS (SELECT DISTINCT host FROM (SELECT {bare("host")} AS host FROM u UNION ALL SELECT src FROM edges UNION ALL SELECT dst FROM edges) WHERE host <> ''),
    seeds AS (SELECT host, CAST({any_of(lambda v, p: v == "block" and p == "/")} AS INT) AS blocked, CAST({any_of(lambda v, p: v == "allow")} AS INT) AS allowed FROM known),
    shares AS (SELECT host, blocked, CASE WHEN blocked = 0 THEN allowed ELSE 0 END AS trusted FROM seeds),
    sums AS (SELECT greatest(1, sum(trusted)) AS trusted, greatest(1, sum(blocked)) AS blocked FROM shares),
    r0 AS MATERIALIZED (SELECT host, x.trusted / s.trusted AS st, x.blocked / s.blocked AS sd, x.trusted / s.trusted AS t, x.blocked / s.blocked AS d FROM shares x, sums s),{ranks}
    bad AS (SELECT host FROM r{rounds} WHERE d > 0.1 / (SELECT count(*) FROM known) AND d > t)
    SELECT page_id, host, path, {first(0)} AS rule, coalesce({first(1)}, CASE WHEN {bare("host")} IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM u"""


ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": NEAR_DUPLICATES,
    "op2_suffix_repetition": REPETITION,
    "op4_suffix_array_dedup": PASSAGES,
    "op7_host_graph": _url_sql(),
    "op5_block_max_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                     CAST(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_incremental_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, length(regexp_replace(role, '(\\|<s>|</s>|\[INST\]|\[/INST\])', '\1+', 'g')) + length(regexp_replace(text, '(\\|<s>|</s>|\[INST\]|\[/INST\])', '\1+', 'g')) + 25 AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars, false AS rewrites_history
        FROM e GROUP BY conv_id""",
}
