"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import chat_format, jpeg, language_id, mixing, ngram_join, packing, pii, quality_rules, sentencepiece_codec, spelling, toxicity, url_filters, vector_codes
from folioflow.llm.common import id_remainder, table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# -- op1 ---------------------------------------------------------------------------------


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"))


# -- op2 ---------------------------------------------------------------------------------


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


#: Word-level shingles as lists, links from shared ones, and what is reachable over links.
OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(words) < 5 THEN [words] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: list_slice(words, i, i + 4))) END) AS shingle
  FROM d WHERE len(words) > 0),
h AS (SELECT doc_id, hash(shingle) AS h FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN least ON a = d.doc_id
"""


# -- op3 ---------------------------------------------------------------------------------


def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["length"], m["train"].cast("int")))
    return chat_format.rotate_whole(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(spans, " "))


OP3_SQL = f"""
WITH said AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
parted AS (
  SELECT *, CAST(coalesce(sum(strlen(text) + strlen(speaker) + {chat_format.TURN_BYTES}) OVER (PARTITION BY conv_id
         ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {chat_format.WHOLE_BYTES} AS BIGINT) AS part FROM said),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
pieces AS (
  SELECT s.conv_id, s.part, p.perspective, s.turn, s.speaker, s.text, s.speaker = p.perspective AS train,
         CASE WHEN s.speaker = p.perspective THEN '<|im_start|>assistant' || chr(10)
              WHEN s.speaker = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || s.speaker || chr(10) END AS head,
         s.text || '<|im_end|>' || chr(10) AS body
  FROM parted s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, row_number() OVER w AS k, CAST(sum(length(head) + length(body)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(body) AS start
  FROM pieces WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, part, CAST(0 AS BIGINT) AS split, perspective, count(*) AS n_turns,
       CAST(count(*) FILTER (train) AS BIGINT) AS n_trained,
       string_agg(head || body, '' ORDER BY k) AS text,
       string_agg(start || ':' || length(body) || ':' || CAST(train AS INTEGER), ' ' ORDER BY k) AS mask
FROM placed GROUP BY conv_id, part, perspective
"""


# -- op4 ---------------------------------------------------------------------------------


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = jpeg.describe(jpeg.store_payloads(table(spark, sf_dir, "documents")))
    return read_back.select(
        "doc_id",
        "n_bytes",
        F.length("thumbnail").cast("long").alias("payload_bytes"),
        F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.substring("thumbnail", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.col("width"), F.lit("x"), F.col("height"), F.lit(" a"), "average_hash", F.lit(" d"), "difference_hash").alias("feature"),
    )


# -- op5 ---------------------------------------------------------------------------------


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality_rules.measure(table(spark, sf_dir, "documents"))
    return quality_rules.verdicts(measured).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _rule_sql(rule: quality_rules.Rule) -> str:
    base = f"({quality_rules.BASES.get(rule.base, rule.base)})".replace("1L", "1").replace("0L", "0").replace("4L", "4")
    return f"({rule.measure} * 100 {rule.sign} {rule.factor} * {base})"


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
spots AS (SELECT rid, unnest(range(1, len(words) - 3)) AS p, words FROM w WHERE len(words) >= 5),
windows AS (SELECT rid, p, list_slice(words, p, p + 4) AS five FROM spots),
twice AS (SELECT rid, p FROM windows QUALIFY count(*) OVER (PARTITION BY rid, five) > 1),
covered AS (SELECT rid, count(DISTINCT p + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (
  SELECT d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w.words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(length(text) - length(translate(text, '{quality_rules.LATIN}', '')) AS BIGINT) AS n_latin,
         CAST(len(list_filter(w.words, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in quality_rules.ALL_STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
v AS (SELECT *, NOT ({" AND ".join(map(_rule_sql, quality_rules.BASE_RULES))}) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(map(_rule_sql, quality_rules.THRESHOLDS))} AS kept
FROM v
"""


# -- op6 ---------------------------------------------------------------------------------


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(id_remainder("doc_id", 5) != 0)
    model = toxicity.fit(documents, labels)
    held = documents.select("doc_id", "text", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    scored = toxicity.score(held, model, keep=("held_out",))
    return scored.select("doc_id", "held_out", "score", toxicity.is_toxic().alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


# -- op7 ---------------------------------------------------------------------------------


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(table(spark, sf_dir, "documents")))


#: The schedule's slots as spans of the unit interval; a source's slots take its first blocks, of as many words.
OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('{mixing.SEED}|' || doc_id), 1, 15) AS BIGINT) AS key FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
weighed AS (SELECT *, CAST(([3, 1, 2])[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM per),
levelled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM weighed WINDOW o AS (ORDER BY source_size * 2 / weight, encode(source) NULLS LAST)),
rated AS (SELECT *, max(rate) FILTER (rate * weight <= source_size * 2) OVER () AS final FROM levelled),
wanted AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce(final * weight, source_size * 2.0::DOUBLE)) AS target FROM rated),
spans AS (
  SELECT source, (sum(target) OVER u - target) / sum(target) OVER () AS low, sum(target) OVER u / sum(target) OVER () AS high, sum(target) OVER () AS total
  FROM wanted WHERE target > 0 WINDOW u AS (ORDER BY encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)),
slots AS (
  SELECT (((slot & {mixing.SPAN - 1}) * {mixing.GOLDEN}) & {mixing.SPAN - 1}) / {float(mixing.SPAN)}::DOUBLE AS point
  FROM (SELECT unnest(range(0, (SELECT CAST(ceil(max(total) / {mixing.BLOCK_TOKENS}) AS BIGINT) FROM spans))) AS slot)),
ends AS (SELECT source, count(*) * {mixing.BLOCK_TOKENS} AS last FROM slots JOIN spans ON point >= low AND point < high GROUP BY 1),
laid AS (
  SELECT d.doc_id, d.source, size, source_size, target, coalesce(last, 0) AS last,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY (key >> 40) % {mixing.BUCKETS}, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source LEFT JOIN ends e ON d.source IS NOT DISTINCT FROM e.source)
SELECT source, doc_id, size, source_size, target,
       greatest(0, least(place + size, last) - place) + greatest(0, least(place + source_size + size, last) - place - source_size) AS taken
FROM laid
"""


# -- op8 ---------------------------------------------------------------------------------


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"))
    model = language_id.fit(documents.filter(~F.col("held_out")))
    return language_id.predict(documents, model, keep=("held_out",))


# -- op9 ---------------------------------------------------------------------------------


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path())
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.element_at("ends", -1).cast("long").alias("n_bytes"),
        F.sha2(F.concat_ws(" ", F.col("starts").cast("array<string>"), F.col("ends").cast("array<string>")), 256).alias("spans_sha256"),
    )


# -- op10 --------------------------------------------------------------------------------

#: Host, path, verdict (fixed by the result contract).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Sites known for spam, with all their mirrors.
SPAM_SITES = tuple(f"{name}.example.{top}" for name in ("spam-farm", "adult-x", "cheap-pills", "free-bets", "casino-win", "ads-track") for top in ("com", "net", "org"))


def spam_list(pages: DataFrame) -> DataFrame:
    """The list that pages are judged by besides the rules: each spam site with each directory that any page has.

    Spam is mirrored, so a directory that is known from one site is listed for all of them: the list has as many entries as there
    are sites times directories, grows with pages, and has every spam page's own directory and none of another site.
    """
    sites = F.explode(F.array(*(F.lit(h) for h in SPAM_SITES)))
    return url_filters.directories(pages).select(sites.alias("host"), "path", F.lit("list").alias("kind"), F.lit("block").alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame([(h, p, "rule", v) for h, p, v in RULES], "host string, path string, kind string, verdict string")
    judged = url_filters.match(pages, spam_list(pages).unionByName(rules))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("kind") == "rule", F.concat("entry_host", "entry_path")).alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )


#: Listed hosts are compared in canonical form: without user name, port and dots at the end, escapes of unreserved characters
#: resolved. Directories are compared as they are: each page's own one is listed, in either form.
_UNESCAPED = "r_host"
for _c in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x2D, 0x2E, 0x5F, 0x7E):
    _UNESCAPED = f"regexp_replace({_UNESCAPED}, '(?i)%{_c:02x}', '{chr(_c).lower()}', 'g')"

OP10_SQL = f"""
WITH rest AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT rid, page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM rest),
canon AS (
  SELECT *, rtrim(regexp_replace({_UNESCAPED}, ':.*$', '', 's'), '.') AS c_host FROM (SELECT *, regexp_replace(host, '^.*@', '', 's') AS r_host FROM parts)),
sites(h) AS (VALUES {", ".join(f"('{h}')" for h in SPAM_SITES)}),
listed(h, p, kind, v) AS (VALUES {", ".join(f"('{h}', '{p}', 'rule', '{v}')" for h, p, v in RULES)}
  UNION ALL SELECT h, p, 'list', 'block' FROM sites CROSS JOIN (SELECT DISTINCT regexp_extract(path, '^.*/|^', 0, 's') AS p FROM parts WHERE host <> '')),
best AS (
  SELECT rid, max_by(struct_pack(h, p, kind, v), struct_pack(a := kind = 'rule', b := length(h) + length(p), c := length(h), d := h, e := p)) AS e
  FROM canon JOIN listed ON (kind = 'rule' AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) OR (kind = 'list' AND (c_host = h OR ends_with(c_host, '.' || h)) AND starts_with(path, p)) GROUP BY rid)
SELECT page_id, host, path, CASE WHEN e.kind = 'rule' THEN e.h || e.p END AS rule, coalesce(e.v, 'allow') AS verdict
FROM parts LEFT JOIN best USING (rid)
"""


# -- op11 --------------------------------------------------------------------------------

#: One in so many words of a document loses a letter (fixed by the result contract).
LOSE_ONE_IN = 97


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"), lose_one_in=LOSE_ONE_IN)


def _crc_step(nibble: int) -> int:
    for _ in range(4):
        nibble = nibble >> 1 ^ (0xEDB88320 if nibble & 1 else 0)
    return nibble


#: crc32 goes over the nibbles of the bytes, the low one first. Near words share what is left without the letter at one place.
OP11_SQL = f"""
WITH RECURSIVE per AS (
  SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS h FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  GROUP BY 1, 2),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, len(h)), lambda i: CAST(strpos('0123456789ABCDEF', substr(h, xor(i, 1) + 1, 1)) - 1 AS BIGINT)),
    lambda c, b: xor([{", ".join(str(_crc_step(k)) for k in range(16))}][(xor(c, b) & 15) + 1], c >> 4), CAST(4294967295 AS BIGINT))) AS crc FROM per),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN crc % {LOSE_ONE_IN} = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {spelling.MIN_LENGTH} GROUP BY 1 HAVING sum(n) >= {spelling.MIN_COUNT}),
less AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS r(i)),
shorter AS (SELECT DISTINCT l.word AS a, l.n AS a_n, s.word AS b, s.n AS b_n FROM less l JOIN words s ON s.word = l.rest),
near AS (
  SELECT x.word AS a, y.word AS b, y.n AS b_n FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION ALL SELECT a, b, b_n FROM shorter UNION ALL SELECT b, a, a_n FROM shorter),
best AS (SELECT a, count(*) AS n_near, min(struct_pack(less := -b_n, form := b)) AS best FROM near GROUP BY 1),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {spelling.FACTOR} * n THEN best.form END AS form,
         CASE WHEN -best.less >= {spelling.FACTOR} * n THEN -best.less END AS form_n FROM words LEFT JOIN best ON a = word),
up(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT up.word, form FROM up JOIN formed f ON f.word = up.root WHERE form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM formed f JOIN up USING (word) JOIN formed r ON r.word = up.root AND r.form IS NULL
"""


# -- op12 --------------------------------------------------------------------------------


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


# -- op13 --------------------------------------------------------------------------------


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op13_sql(parts: int, entries: int, rounds: int, width: int = 4) -> str:
    """Every part against every entry of its codebook, in rounds; for vectors of parts * width components."""
    xs = [f"x{j}" for j in range(width)]
    distance = " + ".join(f"(p.{x} - c.{x}) * (p.{x} - c.{x})" for x in xs)
    steps = ""
    for k in range(rounds + 1):
        steps += f""",
near{k} AS (
  SELECT rid, part, arg_min(entry, distance * {entries} + entry) AS entry, min(distance) AS distance
  FROM (SELECT p.rid, p.part, c.entry, {distance} AS distance FROM p JOIN c{k} c ON c.part = p.part) GROUP BY 1, 2)"""
        if k < rounds:
            steps += f""",
c{k + 1} AS (
  SELECT c.part, c.entry, {", ".join(f"coalesce(m.{x}, c.{x}) AS {x}" for x in xs)} FROM c{k} c LEFT JOIN (
    SELECT part, entry, {", ".join(f"CAST(floor(sum(p.{x}) / count(*)) AS BIGINT) AS {x}" for x in xs)} FROM near{k} JOIN p USING (rid, part) GROUP BY 1, 2) m
  ON m.part = c.part AND m.entry = c.entry)"""
    return f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding FROM embeddings),
v AS (
  SELECT rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE}::DOUBLE * x) AS BIGINT)) AS v FROM e
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, {", ".join(f"v[part * {width} + {j + 1}] AS {x}" for j, x in enumerate(xs))} FROM v, (SELECT unnest(range(0, {parts})) AS part)),
first AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}),
c0 AS (SELECT part, entry, {", ".join(xs)} FROM first JOIN p USING (rid)){steps},
coded AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error FROM near{rounds} GROUP BY 1),
books AS (SELECT sha256(string_agg({" || ',' || ".join(xs)}, ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN coded USING (rid), books
"""


OP13_SQL = _op13_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii_pseudonyms, op2_ngram_join, op3_chat_perspectives, op4_jpeg_media, op5_quality_rules, op6_toxicity, op7_source_mix, op8_language, op9_sentencepiece, op10_url_filters, op11_spelling_variants, op12_best_fit_packing, op13_vector_codes)
}
ORACLE_SQL = {"op2_ngram_join": OP2_SQL, "op7_source_mix": OP7_SQL, "op3_chat_perspectives": OP3_SQL, "op5_quality_rules": OP5_SQL, "op10_url_filters": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op13_vector_codes": OP13_SQL}
