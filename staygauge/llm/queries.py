"""The registered queries of the operators, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staygauge.llm.bpe import digests as bpe_digests
from staygauge.llm.chat import format_conversations, read_back
from staygauge.llm.fill_middle import fill_in_middle
from staygauge.llm.line_dedup import dedup_lines
from staygauge.llm.packing import pack_documents
from staygauge.llm.prefix_trie import prefix_trie
from staygauge.llm.quality import fit_quality, judge_quality, rule_statistics
from staygauge.llm.similarity_join import similarity_classes
from staygauge.llm.simhash import simhash_components
from staygauge.llm.substring_dedup import dedup_substrings
from staygauge.llm.topk import top_k
from staygauge.llm.toxicity import fit_toxicity, held_out, score_toxicity
from staygauge.llm.url_filter import PathRule, judge_urls, mine_rules
from staygauge.session import settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op7_packing")
def packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op8_line_dedup", r"""
WITH lines AS (
    SELECT doc_id, i, line, lower_key AS key, length(lower_key) >= 40 AS long_key FROM (
        SELECT doc_id, i, line, translate(regexp_replace(line, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents))),
repeated AS (
    SELECT key, max(doc_id) AS max_doc FROM lines WHERE long_key GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
    SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.max_doc AS gone FROM lines l LEFT JOIN repeated r ON l.long_key AND l.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def line_dedup(spark, sf_dir):
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_WORDS = r"""words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"""


@query("op4_substring_dedup", rf"""
WITH {_WORDS},
windows AS (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS h,
        unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
every AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words),
kept AS (
    SELECT doc_id, count(*) FILTER (g.j IS NOT NULL) AS n, string_agg(word, ' ' ORDER BY j) FILTER (g.j IS NULL) AS text
    FROM every LEFT JOIN gone g USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
""")
def substring_dedup(spark, sf_dir):
    kept = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_similarity_join", rf"""
WITH RECURSIVE {_WORDS},
sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM words),
copies AS (SELECT s, min(doc_id) AS rep, count(*) AS n_copies FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT rep, len(s) AS size, unnest(s) AS item FROM copies),
links AS (
    SELECT a.rep AS u, b.rep AS v FROM items a JOIN items b ON a.item = b.item AND a.rep <> b.rep
    GROUP BY a.rep, b.rep, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*))),
reach(u, v) AS (SELECT rep, rep FROM copies UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
classes AS (SELECT u AS rep, min(v) AS class_id FROM reach GROUP BY u),
degrees AS (SELECT u AS rep, count(*) AS n_links FROM links GROUP BY u)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM sets LEFT JOIN copies USING (s) LEFT JOIN classes USING (rep) LEFT JOIN degrees USING (rep)
""")
def similarity_join(spark, sf_dir):
    return similarity_classes(table(spark, sf_dir, "documents"))


@query("op1_toxicity")
def toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
                         F.size("passages").alias("n_passages"))


@query("op6_quality")
def quality(spark, sf_dir):
    stats = settle(rule_statistics(table(spark, sf_dir, "documents")), "rule_statistics")
    labels = table(spark, sf_dir, "labels")
    forest = fit_quality(stats, labels.filter(~held_out(F.col("doc_id"))))
    return judge_quality(stats, forest).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


@query("op3_bpe")
def bpe(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def _escaped(column: str) -> str:
    """The template's escaping in SQL: a backslash after the first character of a control string."""
    headers = f"regexp_replace({column}, '#(\\\\*)(## (System|User|Assistant|Tool|Role): )', '#\\\\\\1\\2', 'g')"
    return f"regexp_replace({headers}, '<(\\\\*)(/turn>|/role>|\\|endoftext\\|>)', '<\\\\\\1\\2', 'g')"


@query("op2_chat_format", f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
sized AS (
    SELECT *, length(CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN '### ' || role || ': '
                     ELSE '### Role: ' || {_escaped("role")} || '</role>' END)
        + length({_escaped("text")}) + length('</turn>') AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""")
def chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = tokenizer_path("byte_bpe_50k.json")
    return read_back(format_conversations(rows.unionByName(extra), path), path)


# Fixed values of the contract.
PATH_RULES = [
    PathRule("allow", "org", "/"), PathRule("block", "example.org", "/es/"), PathRule("block", "example.org", "/en/1"),
    PathRule("allow", "com", "/fr/"), PathRule("block", "com", "/de/"),
]


@query("op10_url_filter")
def url_filter(spark, sf_dir):
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    bad = labels.filter(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(pages, PATH_RULES, mine_rules(pages, bad)).select("page_id", "host", "path", "rule", "verdict")


@query("op9_topk", """
WITH good AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM good q JOIN good c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
""")
def topk(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op11_fill_middle", """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
        sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (
    SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
formed AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
    SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix
    FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
           ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
""")
def fill_middle(spark, sf_dir):
    return fill_in_middle(table(spark, sf_dir, "documents"))


@query("op13_simhash")
def simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


# crc32 of a number's decimal digits, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


@query("op12_prefix_trie", f"""
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS s,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS own, {_CRC32} % 4 AS h, conv_id - conv_id % 20 AS base FROM t GROUP BY conv_id),
info AS (
    SELECT a.*, least(a.h, coalesce(b.own, 0)) AS shared, least(a.h, coalesce(b.own, 0)) + greatest(a.own - a.h, 0) AS length
    FROM own a LEFT JOIN own b ON b.conv_id = a.base),
turns AS (
    SELECT conv_id, r - h + shared AS d, s, words, r - h + shared = length AS last FROM t JOIN info USING (conv_id) WHERE r > h
    UNION ALL
    SELECT i.conv_id, t.r, t.s, t.words, t.r = length FROM info i JOIN t ON t.conv_id = i.base AND t.r <= i.shared),
prefixes AS (
    SELECT conv_id, d, md5(string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node, words, last FROM turns
    UNION ALL SELECT conv_id, 0, 'root', 0, length = 0 FROM info),
nodes AS (
    SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
    FROM prefixes GROUP BY d, node),
linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, p.node AS parent FROM nodes n
    LEFT JOIN prefixes x ON x.conv_id = n.conv_id AND x.d = n.d - 1 LEFT JOIN nodes p ON p.d = x.d AND p.node = x.node),
children AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
sums AS (
    SELECT x.d, x.node, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.words)::BIGINT AS saved_tokens
    FROM nodes u LEFT JOIN children c USING (d, node) JOIN prefixes x ON x.conv_id = u.conv_id AND x.d <= u.d GROUP BY x.d, x.node)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, ends_sha256
FROM linked LEFT JOIN children USING (d, node) JOIN sums USING (d, node)
""")
def conversation_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
