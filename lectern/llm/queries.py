"""The operators as registered queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lectern.llm import decontaminate, linededup, mixing, pii, quality, repair, secrets, sharding, simhash, substrings, tokencounts, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _tokenizer(name: str = "byte_bpe_50k.json") -> str:
    """Where the driver finds a public tokenizer's definition."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _span_columns(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts and a digest of the base spans, and all spans as text."""

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_columns(pii.find_spans(_table(spark, sf_dir, "documents")), pii.KINDS)


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query(
    "op3_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, i AS line_no, regexp_extract_all(lower(parts[i]), '[^\x20\x09-\x0D]+') AS words, parts[i] AS line
      FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
    ), named AS (SELECT *, array_to_string(words, ' ') AS shown FROM lines),
    firsts AS (
      SELECT shown, any_value(words) AS words, min((doc_id, line_no)) AS first FROM named WHERE len(words) > 0 GROUP BY shown
    ), variants AS (
      SELECT shown, first, len(words) AS n, p, array_to_string(list_concat(words[1:p - 1], words[p + 1:]), ' ') AS variant
      FROM (SELECT *, unnest(range(1, len(words) + 1)) AS p FROM firsts WHERE len(words) >= 4)
    ), short AS (SELECT shown, first, len(shown) AS n FROM firsts WHERE len(words) < 4),
    by_character AS (
      SELECT shown, first, n, p, shown[1:p - 1] || shown[p + 1:] AS variant
      FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM short WHERE n >= 8)
    ), near AS (
      SELECT a.shown FROM variants a JOIN variants b USING (variant, p, n) WHERE b.first < a.first
      UNION SELECT a.shown FROM variants a JOIN firsts b ON a.variant = b.shown WHERE b.first < a.first
      UNION SELECT b.shown FROM variants a JOIN firsts b ON a.variant = b.shown WHERE a.first < b.first
      UNION SELECT a.shown FROM by_character a JOIN by_character b USING (variant, p, n) WHERE b.first < a.first
      UNION SELECT a.shown FROM by_character a JOIN short b ON a.variant = b.shown WHERE b.first < a.first
      UNION SELECT b.shown FROM by_character a JOIN short b ON a.variant = b.shown WHERE a.first < b.first
    ), judged AS (
      SELECT doc_id, line_no, line,
        len(words) > 0 AND ((doc_id, line_no) <> first OR shown IN (SELECT shown FROM near)) AS gone
      FROM named LEFT JOIN (SELECT shown, first FROM firsts) USING (shown)
    )
    SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_removed,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"))


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer())


@query(
    "op7_source_mixing",
    r"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
    ), sources AS (
      SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS most,
        [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
      FROM sized GROUP BY source
    ), shares AS (
      SELECT *, (1.5 * sum(source_size) OVER ()
          - coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
      FROM sources
    ), level AS (SELECT min_by(share, most / weight) AS level FROM shares WHERE share <= most / weight),
    targets AS (SELECT source, source_size, least(most::DOUBLE, weight * level) AS target FROM shares, level),
    queues AS (
      SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS ends
      FROM sized JOIN targets USING (source)
    ), turns AS (
      SELECT doc_id, source, size, turn, (ends + turn * source_size)::DOUBLE / target AS finish
      FROM queues, range(2) AS t(turn) WHERE size > 0
    ), served AS (
      SELECT *, sum(size) OVER (ORDER BY finish, source, md5(doc_id::VARCHAR), doc_id, turn ROWS UNBOUNDED PRECEDING) AS upto FROM turns
    ), copies AS (
      SELECT doc_id, count(*) AS n FROM served WHERE upto <= (SELECT floor(sum(target) + 0.5) FROM targets) GROUP BY doc_id
    )
    SELECT doc_id, size, source_size, target, (coalesce(n, 0) * size)::BIGINT AS taken FROM queues LEFT JOIN copies USING (doc_id)
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op8_substring_dedup",
    r"""
    WITH split AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), windows AS (
      SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS shown
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM split WHERE len(words) >= 50)
    ), firsts AS (SELECT shown, min(doc_id) AS first FROM windows GROUP BY shown),
    gone AS (
      SELECT doc_id, list(DISTINCT place) AS places
      FROM (SELECT doc_id, unnest(range(i, i + 50)) AS place FROM windows JOIN firsts USING (shown) WHERE doc_id > first)
      GROUP BY doc_id
    ), cut AS (
      SELECT doc_id, len(words) AS n_words,
        CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END AS kept
      FROM split LEFT JOIN gone USING (doc_id)
    )
    SELECT doc_id, n_words, n_words - len(kept) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM cut
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_texts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op10_benchmark_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op11_secrets")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_columns(secrets.find_secrets(_table(spark, sf_dir, "documents")), secrets.BASE_KINDS)


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut, repeated or given to the user, by a checksum of their id and number."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _repair_sql() -> str:
    """The grammar's states are nothing yet, after system, after user, after assistant: places 1 to 4 of ``f``.

    Each of them has the cheapest cost, edits and transcript from a turn to the end; equal costs are told by the edits.
    """

    def way(cost: str, edit: str, line: str, place: int, of: str = "f") -> str:
        at = f"{of}[{place}]"
        return f"struct_pack(c := {at}.c + {cost}, a := '{edit}' || {at}.a, o := {line} || {at}.o)"

    put_in = {1: ("user", 3), 2: ("user", 3), 3: ("assistant", 4), 4: ("user", 3)}
    stays = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}
    judged, given = [], []
    for place, (role, to) in put_in.items():
        ways = [way("4", "D", "''", place)]
        turned = way("3 + extra", "R", f"chr(10) || '{role}:' || text", to)
        ways.append(f"CASE WHEN fault NOT IN (1, 2) THEN {turned} END")
        for initial, after in stays[place].items():
            kept = way("extra", "K", "chr(10) || role || ':' || text", after)
            ways.append(f"CASE WHEN fault NOT IN (1, 2) AND role[1] = '{initial}' THEN {kept} END")
        judged.append(f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))")
        once = way("3", "I", f"chr(10) || '{role}:'", to, "g")
        second, beyond = put_in[to]
        twice = way("6", "II", f"chr(10) || '{role}:' || chr(10) || '{second}:'", beyond, "g")
        given.append(f"list_min([g[{place}], {once}, {twice}])")
    return rf"""
    WITH RECURSIVE crc AS (
      SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ), kinds AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295, list_transform(
          string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
      FROM conversations, crc
    ), harmed AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
      FROM kinds WHERE kind <> 0
    ), numbered AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM harmed
    ), faults AS (
      SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
        lead(role) OVER (PARTITION BY conv_id ORDER BY i) AS following
      FROM numbered
    ), turns AS (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS extra FROM faults),
    counted AS (
      SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
        count_if(following IS NOT NULL AND role[1] || following[1] NOT IN ('su', 'ua', 'au')) AS illegal
      FROM turns GROUP BY conv_id
    ), ways(conv_id, i, f) AS (
      SELECT conv_id, n + 1, [struct_pack(c := 0::BIGINT, a := '', o := ''),
        struct_pack(c := 6::BIGINT, a := 'II', o := chr(10) || 'user:' || chr(10) || 'assistant:'),
        struct_pack(c := 3::BIGINT, a := 'I', o := chr(10) || 'assistant:'), struct_pack(c := 0::BIGINT, a := '', o := '')]
      FROM counted
      UNION ALL
      SELECT conv_id, i, [{', '.join(given)}]
      FROM (SELECT w.conv_id, t.i, [{', '.join(judged)}] AS g
        FROM ways w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.i = t.i + 1)
    ), best AS (SELECT conv_id, f[1] AS b FROM ways WHERE i = 1)
    SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
      coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
      coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.o, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) ids
    LEFT JOIN counted ON ids.conv_id IS NOT DISTINCT FROM counted.conv_id
    LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id
    """


@query("op13_conversation_repair", _repair_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    repaired = repair.repair(damaged(conversations))
    summary, digests = repaired.summary, repair.transcript_digests(repaired.turns)
    ids = conversations.select(F.col("conv_id").cast("bigint")).distinct()
    told = ids.join(summary, repair.same_id(ids, summary), "left").join(digests, repair.same_id(ids, digests), "left")
    numbers = [F.coalesce(summary[c], F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select(
        ids["conv_id"], *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
