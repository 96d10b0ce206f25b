"""The registered queries of this folder; each takes (spark, folder) and reads whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    digest_index,
    near_dedup,
    packing,
    page_extraction,
    prefix_trie,
    quality_rules,
    secret_scan,
    spelling_groups,
    substring_dedup,
    suffix_dedup,
    token_rollup,
    url_filter,
)
from .shared import documents, shared_folder, stored

QUERIES = {}
ORACLES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def vocabulary() -> packing.Vocabulary:
    path = public_tokenizers.path
    return packing.Vocabulary(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def new_index(spark: SparkSession) -> digest_index.DigestIndex:
    """An empty index with a name of its own."""
    name = shared_folder(spark).rpartition("/")[2]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return digest_index.DigestIndex(spark, f"digest_index_{name}", buckets)


@query
def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(documents(spark, folder))


@query
def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents go into the index, and come again as a second batch, of which nothing is new.

    So the second anti-join meets the whole index, and all rows of the result come from it.
    """
    docs, index = documents(spark, folder), new_index(spark)
    index.add(digest_index.best_per_digest(digest_index.fingerprints(docs)), "documents")
    return digest_index.deduplicate(docs, index, "documents again")


ORACLES["op2_exact_dedup"] = r"""
WITH marked AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
    FROM documents
), ordered AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM marked
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ordered
"""


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets(documents(spark, folder))


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = quality_rules.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return quality_rules.quality(docs, model)


@query
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip_digests(documents(spark, folder), path, public_tokenizers.PATTERN)


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents go in; those labelled toxic are taken out; those labelled of low quality are counted anew.

    The new count has an end mark. The first batch is committed twice, as after a failure.
    """
    name = "byte_bpe_50k"
    path, version = public_tokenizers.path(f"{name}.tiktoken"), name
    counted = stored(token_rollup.count_tokens(documents(spark, folder), path, public_tokenizers.PATTERN))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    ids = lambda condition: labels.filter(condition).select("doc_id").distinct()
    toxic = counted.join(ids("toxic = 1"), "doc_id", "left_semi")
    poor = counted.join(ids("quality = 0 AND toxic = 0"), "doc_id", "left_semi")
    poor = poor.withColumns({"old_tokens": F.col("n_tokens"), "n_tokens": F.col("n_tokens") + 1})
    rollup = token_rollup.TokenRollup(spark, shared_folder(spark))
    rollup.commit("load", token_rollup.inserts(counted, version))
    rollup.commit("toxic", token_rollup.deletes(toxic, version))
    rollup.commit("recount", token_rollup.revisions(poor, version))
    rollup.commit("load", token_rollup.inserts(counted, version))
    return rollup.totals()


@query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder), vocabulary())


@query
def op8_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return page_extraction.main_text(spark.read.parquet(f"{folder}/pages.parquet"))


@query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated_words(documents(spark, folder))


ORACLES["op9_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS s
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w)),
low AS (SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM (SELECT doc_id, i FROM win JOIN low USING (s) WHERE first_doc < doc_id),
         range(50) AS t(k)),
kept AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM w)
         ANTI JOIN gone USING (doc_id, pos)),
text_left AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t FROM kept GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN text_left USING (doc_id)
"""


@query
def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, folder))


ORACLES["op10_near_dedup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, y FROM reach JOIN links ON other = x),
least_id AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least_id LEFT JOIN sizes USING (doc_id)
"""


@query
def op11_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups.spelling_groups(spelling_groups.vocabulary(documents(spark, folder)))


# The unsigned CRC-32 of a text, bit by bit; 3988292384 is the reversed polynomial.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen({0}), 2),
    lambda k: ('0x' || hex(encode({0}))[k:k + 1])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

ORACLES["op11_spelling_groups"] = rf"""
WITH RECURSIVE run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
once AS (SELECT id, run, id || ':' || run AS marked, count(*) AS k FROM run GROUP BY ALL),
hashed AS (SELECT run, k, {CRC32.format("marked")} AS h FROM once),
slipped AS (SELECT k, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
holes AS (SELECT word, i, word[:i - 1] || '*' || word[i + 1:] AS s FROM cut),
shorter AS (SELECT DISTINCT word, word[:i - 1] || word[i + 1:] AS s FROM cut),
removed AS (SELECT shorter.word AS a, words.word AS b FROM shorter JOIN words ON shorter.s = words.word),
near AS (SELECT a.word AS word, b.word AS near FROM holes a JOIN holes b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
         UNION SELECT a, b FROM removed UNION SELECT b, a FROM removed),
ranked AS (SELECT near.word, near.near, w.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near,
           row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near.near) AS r FROM near JOIN words w ON near.near = w.word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * words.n THEN near END AS form,
          CASE WHEN near_n >= 2 * words.n THEN near_n END AS form_n FROM words LEFT JOIN ranked ON words.word = ranked.word AND r = 1),
chain AS (SELECT word, word AS root FROM forms UNION ALL
          SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, chain.root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN chain ON forms.word = chain.word JOIN forms last ON chain.root = last.word WHERE last.form IS NULL
"""


SITES = [
    url_filter.Rule("net/", "block"),
    url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"),
    url_filter.Rule("org/fr/", "allow"),
]


@query
def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return url_filter.judged(pages, SITES).select("page_id", "host", "path", "rule", "verdict")


@query
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


ORACLES["op13_prefix_trie"] = rf"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
               {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS step FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS name, list(step ORDER BY i) AS steps FROM turns GROUP BY conv_id),
marked AS (SELECT *, {CRC32.format("name")} % 9 AS h FROM own),
rebuilt AS (SELECT a.conv_id, list_concat(coalesce(b.steps[1:a.h], []), a.steps[a.h + 1:]) AS steps
            FROM marked a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
member AS (SELECT conv_id, len(steps) AS n, d AS depth, sha256(CAST(steps[1:d] AS VARCHAR)) AS node,
           CASE WHEN d > 0 THEN sha256(CAST(steps[1:d - 1] AS VARCHAR)) END AS parent, steps[d].text AS text
           FROM (SELECT conv_id, steps, unnest(range(0, len(steps) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
          (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(any_value(text)) END AS saved,
          sha256(coalesce(string_agg(CASE WHEN depth = n THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
          FROM member GROUP BY node, depth),
child AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN child USING (node, depth)),
up AS (SELECT DISTINCT below.node AS below, below.depth AS below_depth, above.node, above.depth
       FROM member below JOIN member above ON below.conv_id = above.conv_id AND above.depth <= below.depth),
totals AS (SELECT up.node, up.depth, count(*) FILTER (below.n_children = 0) AS n_leaves, CAST(sum(below.saved) AS BIGINT) AS saved_tokens
           FROM up JOIN full_nodes below ON up.below = below.node AND up.below_depth = below.depth GROUP BY ALL)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, a.ends_sha256
FROM full_nodes a JOIN totals USING (node, depth) LEFT JOIN full_nodes p ON a.parent = p.node AND a.depth = p.depth + 1
"""
