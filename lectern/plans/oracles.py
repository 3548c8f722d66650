"""The registered queries as DuckDB SQL over the same tables, written without looking at the Spark plans."""

from __future__ import annotations

from lectern import fixed
from lectern.operators.permutation import PRIME, round_keys
from lectern.plans.catalog import CAP, MAX_TOKENS, VOCABULARY


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = q(fixed.WHITESPACE)
PIECES = r"'[\p{L}\p{N}]+|[^\p{L}\p{N}\t\n\x0B\f\r ]'"


def strip(value: str) -> str:
    return f"trim({value}, {WS})"


def key(name: str, column: str) -> str:
    return f"'{name}:' || lpad(CAST({column} AS VARCHAR), 19, '0')"


def order_key(value: str) -> str:
    return f"md5(CAST({value} AS VARCHAR) || '|{fixed.SHUFFLE_SEED}')"


def response(thinking: str, solution: str) -> str:
    reasoning = rf"'<reasoning>' || chr(10) || {thinking} || chr(10) || '</reasoning>'"
    answer = rf"'<answer>' || chr(10) || {solution} || chr(10) || '</answer>'"
    return (
        f"CASE WHEN {thinking} <> '' AND {solution} <> '' THEN {reasoning} || chr(10) || chr(10) || {answer} "
        f"WHEN {thinking} <> '' THEN {reasoning} ELSE {answer} END"
    )


def exchange_text(problem: str, answer: str) -> str:
    return f"{q(fixed.BOS + fixed.USER_TURN)} || {problem} || {q(fixed.END_OF_TURN + fixed.MODEL_TURN)} || {answer} || {q(fixed.END_OF_TURN)}"


def boxed(value: str) -> str:
    return rf"CASE WHEN len({value}) > 0 THEN {strip(f'{value}[-1]')} END"


def boxes(value: str) -> str:
    return rf"regexp_extract_all({value}, '\\boxed\{{([^}}]*)\}}', 1)"


REASONING = f"""
raw AS (
  SELECT doc_id, source, {key('documents', 'doc_id')} AS row_key,
         CASE WHEN lang = 'fr' THEN '  ' ELSE ' ' || text || ' ' END AS problem,
         CASE WHEN lang = 'fr' THEN chr(9) || text || chr(10) ELSE 'unused' END AS question,
         CASE WHEN lang = 'de' THEN text WHEN lang <> 'es' THEN ' ' END AS thinking,
         CASE lang WHEN 'en' THEN '<THINK>' || chr(10) || text || ' </think> tail <think>b</think>'
                   WHEN 'es' THEN text WHEN 'de' THEN '<think>unused</think>' END AS generation,
         CASE WHEN source <> 'src0' THEN 'so \\boxed{{' || doc_id || '}} ' END AS solution
  FROM documents
),
normal AS (
  SELECT doc_id, source, row_key, generation,
         coalesce(nullif({strip('problem')}, ''), {strip('question')}, '') AS problem,
         coalesce({strip('thinking')}, '') AS thinking, coalesce({strip('solution')}, '') AS solution
  FROM raw
),
thought AS (
  SELECT * REPLACE (CASE WHEN thinking <> '' THEN thinking
                         ELSE coalesce({strip("regexp_extract(generation, '(?is)<think>(.*?)</think>', 1)")}, '') END AS thinking)
  FROM normal
),
answered AS (SELECT *, {response('thinking', 'solution')} AS response FROM thought)
"""

EXCHANGES = f"""
exchanges AS (
  SELECT 'conversations' AS source,
         'conversations:' || lpad(CAST(a.conv_id AS VARCHAR), 19, '0') || ':' || lpad(CAST(a.turn AS VARCHAR), 19, '0') AS row_key,
         a.text AS problem, b.text AS solution
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant'
)
"""

INSTRUCTIONS = f"""
instructions AS (
  SELECT doc_id, 'Write in ' || lang AS instruction,
         CASE WHEN lang = 'es' THEN ' ' || chr(12288) WHEN lang <> 'de' THEN text END AS input,
         CASE WHEN lang <> 'fr' THEN text END AS output
  FROM documents
),
prompted AS (
  SELECT *, {q(fixed.BOS + fixed.USER_TURN + fixed.TEACHER_SYSTEM)} || chr(10) || chr(10) || instruction
            || CASE WHEN {strip('input')} <> '' THEN chr(10) || chr(10) || input ELSE '' END
            || {q(fixed.END_OF_TURN + fixed.MODEL_TURN)} AS prompt
  FROM instructions
)
"""

COMPLETIONS = r"""
completions AS (
  SELECT doc_id // 4 AS prompt_id, CAST(doc_id % 4 AS INTEGER) AS gen_idx, source,
         CASE doc_id % 5 WHEN 0 THEN '</reasoning>' || text || '<reasoning>' WHEN 1 THEN '<reasoning>' || text
              ELSE '<reasoning>' || chr(10) || ' ' || text || ' ' || chr(10) || '</reasoning>' END
         || CASE WHEN doc_id % 7 = 0 THEN ' no box' ELSE ' \boxed{1} \boxed{ ' || doc_id % 3 || ' }' END AS completion
  FROM documents
),
prompts AS (
  SELECT DISTINCT doc_id // 4 AS prompt_id, 'so \boxed{' || (doc_id // 4) % 3 || '}' AS answer FROM documents
)
"""

SCORED = f"""
scored AS (
  SELECT prompt_id, gen_idx, source,
         CASE WHEN instr(completion, '<reasoning>') > 0 AND instr(completion, '</reasoning>') > 0
                   AND instr(completion, '<reasoning>') < instr(completion, '</reasoning>')
              THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS format_reward,
         CASE WHEN {boxed('found')} = {boxed('gold')} THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS correctness_reward
  FROM (SELECT *, {boxes('completion')} AS found, {boxes('answer')} AS gold FROM completions JOIN prompts USING (prompt_id))
),
totals AS (SELECT *, format_reward + correctness_reward AS reward FROM scored)
"""

ADVANTAGE = f"""
round((reward - avg(reward) OVER p) / (coalesce(stddev_samp(reward) OVER p, 0) + {fixed.ADVANTAGE_EPS}), 6) + 0.0
"""


def encoded(table: str, ids: str, vocabulary_from: str = "") -> str:
    """CTEs ``vocab`` and ``enc`` (the id columns, ``ids``, ``n_tokens``)."""
    return f"""
vocab AS (
  SELECT piece, n, CAST(row_number() OVER (ORDER BY n DESC, piece) + {fixed.RESERVED_IDS - 1} AS INTEGER) AS id
  FROM (SELECT piece, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all(text, {PIECES})) AS piece FROM {vocabulary_from or table})
        GROUP BY piece ORDER BY n DESC, piece LIMIT {VOCABULARY})
),
split AS (SELECT {ids}, regexp_extract_all(text, {PIECES}) AS pieces FROM {table}),
flat AS (SELECT {ids}, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM split),
listed AS (SELECT {ids}, list(coalesce(id, {fixed.UNK_ID}) ORDER BY pos) AS ids FROM flat LEFT JOIN vocab USING (piece) GROUP BY {ids}),
enc AS (SELECT {ids}, coalesce(listed.ids, []::INTEGER[]) AS ids, CAST(len(pieces) AS INTEGER) AS n_tokens
        FROM split LEFT JOIN listed USING ({ids}))
"""


def commas(value: str) -> str:
    return f"array_to_string({value}, ',')"


def padded(fill: int) -> str:
    return commas(f"list_resize(ids, {MAX_TOKENS}, {fill})")


MASK = commas(f"list_resize(list_resize([]::INTEGER[], least(n_tokens, {MAX_TOKENS}), 1), {MAX_TOKENS}, 0)")

LOSS = f"""
entries AS (
  SELECT a.vec_id // 10 AS example_id, CAST(a.vec_id % 10 AS INTEGER) AS pos, a.label,
         unnest(a.embedding)::DOUBLE AS raw, unnest(a.embedding)::DOUBLE / {fixed.LOSS_TEMPERATURE} AS s,
         unnest(b.embedding)::DOUBLE / {fixed.LOSS_TEMPERATURE} AS t, generate_subscripts(a.embedding, 1) - 1 AS token_id
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
),
refusals AS (
  SELECT a.vec_id // 10 AS example_id, count(*) FILTER (WHERE a.vec_id % 11 = 0 AND a.label <> 0) AS n_refused
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1
),
sums AS (
  SELECT example_id, pos, label, ln(sum(exp(s))) AS s_lse, ln(sum(exp(t))) AS t_lse, ln(sum(exp(raw))) AS raw_lse,
         sum(exp(t) * s) / sum(exp(t)) AS t_s, sum(exp(t) * t) / sum(exp(t)) AS t_t,
         max(raw) FILTER (WHERE token_id = label) AS at_label
  FROM entries GROUP BY ALL
),
per_token AS (
  SELECT example_id, label <> 0 AND (10 * example_id + pos) % 11 <> 0 AS counted, s_lse - t_s AS soft_ce, (s_lse - t_s) - (t_lse - t_t) AS kl, raw_lse - at_label AS hard_ce
  FROM sums
),
per_example AS (
  SELECT example_id, count(*) FILTER (WHERE counted) AS n_tokens,
         coalesce(avg(soft_ce) FILTER (WHERE counted), 0) * {fixed.LOSS_TEMPERATURE ** 2} AS soft_ce,
         coalesce(avg(kl) FILTER (WHERE counted), 0) * {fixed.LOSS_TEMPERATURE ** 2} AS kl,
         coalesce(avg(hard_ce) FILTER (WHERE counted), 0) AS hard_ce
  FROM per_token GROUP BY example_id
)
"""
LOSSES = f"""
WITH {LOSS}
SELECT example_id, n_tokens, n_refused, round(soft_ce, 6) AS soft_ce, round(kl, 6) AS kl, round(hard_ce, 6) AS hard_ce,
       round({fixed.LOSS_ALPHA} * soft_ce + {1 - fixed.LOSS_ALPHA} * hard_ce, 6) AS loss
FROM per_example JOIN refusals USING (example_id)
"""
# An entry form has no row for a position without a teacher, so it knows of no refusal.
LONG_LOSSES = f"SELECT * REPLACE (0::BIGINT AS n_refused) FROM ({LOSSES})"


def suffixed(problem: str) -> str:
    return f"{problem} || {q(fixed.INSTRUCTION_SUFFIX)}"


BENCHMARK_ROWS = f"SELECT 'benchmark' AS source, {key('benchmark', 'item_id')} AS row_key, {strip('text')} AS problem, '' AS thinking, '' AS solution FROM benchmark"

def addressable() -> str:
    """Rounds over the two sides of a rectangle, written out; what comes out beyond n goes through again."""
    side = {0: "x.l", 1: "x.r"}
    once = "{'l': spot % w, 'r': spot // w}"
    for i, (a, b) in enumerate(round_keys(fixed.SHUFFLE_SEED)):
        by, moved, size = side[1 - i % 2], side[i % 2], "w" if i % 2 == 0 else "h"
        shifted = f"(({by} % {PRIME} + {a}) % {PRIME})"
        again = f"((({shifted} * {shifted}) % {PRIME} * {b} + {shifted}) % {PRIME})"
        after = f"({moved} + (({again} * {again} + {a}) % {PRIME}) % {size}) % {size}"
        sides = {"l": after if i % 2 == 0 else "x.l", "r": after if i % 2 else "x.r"}
        once = f"list_transform([{once}], lambda x: {{'l': {sides['l']}, 'r': {sides['r']}}})[1]"
    return f"""
        WITH RECURSIVE sizes AS (
          SELECT n, w, ((n + w - 1) // w) AS h FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS w FROM documents)
        ), walk AS (
          SELECT doc_id, position, position AS spot, 0 AS turn FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
          UNION ALL
          SELECT doc_id, position, x.r * w + x.l, turn + 1
          FROM (SELECT doc_id, position, turn, w, {once} AS x FROM walk, sizes WHERE turn = 0 OR spot >= n)
        )
        SELECT doc_id, position, max_by(spot, turn) AS place, position AS back FROM walk GROUP BY doc_id, position"""


def training_union(limit: str) -> str:
    return f"""
united AS (
  SELECT source, row_key, problem, thinking, solution FROM thought
  UNION ALL SELECT source, row_key, {strip('problem')}, '', {strip('solution')} FROM exchanges
  UNION ALL {BENCHMARK_ROWS}
),
drawn AS (
  SELECT source, row_key, {order_key('row_key')} AS order_key,
         {exchange_text(suffixed('problem'), '(' + response('thinking', 'solution') + ')')} AS text
  FROM united ORDER BY order_key, row_key {limit}
)
"""


def trained(limit: str) -> str:
    return f"""
        WITH {REASONING}, {EXCHANGES}, {training_union(limit)}, {encoded('drawn', 'source, row_key, order_key', 'documents')}
        SELECT source, row_key, order_key, n_tokens, {padded(fixed.PAD_ID)} AS input_ids, {MASK} AS attention_mask,
               {padded(fixed.IGNORED_LABEL)} AS labels
        FROM enc WHERE n_tokens <= {MAX_TOKENS}"""


SUPERVISED = f"""
        WITH {REASONING}, {EXCHANGES},
        united AS (
          SELECT source, row_key, problem, thinking, solution FROM normal
          UNION ALL SELECT source, row_key, {strip('problem')}, '', {strip('solution')} FROM exchanges
          UNION ALL {BENCHMARK_ROWS}),
        shown AS (
          SELECT source, row_key, {exchange_text('problem', '(' + response('thinking', 'solution') + ')')} AS text,
                 {order_key('row_key')} AS order_key FROM united)
"""


def content_key(source: str, text: str) -> str:
    """Rows without a key are known by the digest of their one text as JSON, and the number of the copy."""
    escaped = f"to_json({text})::VARCHAR"
    return f"'{source}:' || md5('{{\"text\":' || {escaped} || '}}') || ':' || lpad(CAST(row_number() OVER (PARTITION BY {text}) AS VARCHAR), 19, '0')"



ORACLES: dict[str, str] = {
    "source_json": f"SELECT 'documents' AS source, {key('documents', 'doc_id')} AS row_key, doc_id, text, lang, n_chars FROM documents",
    "source_parquet": f"""SELECT 'documents' AS source, {key('documents', 'doc_id')} AS row_key, doc_id, text, lang,
        source AS own_source, n_chars FROM documents""",
    "multi_source": f"""
        WITH rows AS (
          SELECT 'documents' AS source, {key('documents', 'doc_id')} AS row_key, 'Write in ' || lang AS problem,
                 {strip('text')} AS solution FROM documents
          UNION ALL SELECT 'benchmark', {key('benchmark', 'item_id')}, {strip('text')}, '' FROM benchmark
          UNION ALL SELECT 'pages', {key('pages', 'page_id')}, {strip('url')}, {strip('html')} FROM pages)
        SELECT source, row_key, {exchange_text(suffixed('problem'), '(' + response("''", 'solution') + ')')} AS text FROM rows""",
    "jsonl_roundtrip": f"WITH {INSTRUCTIONS} SELECT doc_id, instruction, input, output, output AS response FROM prompted",
    "training_shards": f"""
        WITH {encoded('documents', 'doc_id')}
        SELECT {order_key('doc_id')} AS order_key, doc_id, n_tokens, {padded(fixed.PAD_ID)} AS input_ids,
               {MASK} AS attention_mask, {padded(fixed.IGNORED_LABEL)} AS labels
        FROM enc WHERE n_tokens <= {MAX_TOKENS}""",
    "normalize_columns": f"WITH {REASONING} SELECT doc_id, problem, thinking, solution FROM normal",
    "instruction_suffix": f"WITH {REASONING} SELECT doc_id, {suffixed('problem')} AS problem FROM normal",
    "extract_thinking": f"WITH {REASONING} SELECT doc_id, thinking FROM thought",
    "assemble_response": f"WITH {REASONING} SELECT doc_id, response FROM answered",
    "build_messages": f"""
        WITH {REASONING}
        SELECT doc_id, 0 AS idx, 'user' AS role, problem AS content FROM answered
        UNION ALL SELECT doc_id, 1, 'model', response FROM answered""",
    "chat_render": f"""
        WITH placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
        whole AS (
          SELECT conv_id, count(*) AS n_turns, bool_and((role = 'user') = (i % 2 = 0)) AS valid,
                 string_agg(CASE role WHEN 'user' THEN {q(fixed.USER_TURN)} || text || {q(fixed.END_OF_TURN)}
                                      WHEN 'assistant' THEN {q(fixed.MODEL_TURN)} || text || {q(fixed.END_OF_TURN)}
                                      ELSE '' END, '' ORDER BY i) AS body
          FROM placed GROUP BY conv_id)
        SELECT conv_id, 0::BIGINT AS part, n_turns, valid, CASE WHEN valid THEN {q(fixed.BOS)} || body ELSE '' END AS text FROM whole""",
    "teacher_prompt": f"WITH {INSTRUCTIONS} SELECT doc_id, prompt FROM prompted",
    "rl_format": f"""
        WITH {EXCHANGES},
        rows AS (
          SELECT source, row_key, problem, solution AS answer FROM exchanges
          UNION ALL SELECT 'documents', {key('documents', 'doc_id')}, lang, text FROM documents
          UNION ALL SELECT 'benchmark', {key('benchmark', 'item_id')}, text, '' FROM benchmark)
        SELECT source, row_key, 'user' AS role, {q(fixed.REWARD_SYSTEM)} || chr(10) || chr(10) || problem AS content, answer FROM rows""",
    "preview": f"""
        SELECT {order_key('doc_id')} AS order_key, doc_id, substring(text, 1, {fixed.PREVIEW_CHARS}) AS preview
        FROM documents ORDER BY 1, 2 LIMIT 1""",
    "strip_unicode": f"SELECT doc_id, {strip('text')} AS text FROM documents",
    "extract_tagged_answer": f"SELECT doc_id, {strip('text')} AS answer FROM documents",
    "extract_boxed": rf"""
        SELECT doc_id, CASE lang WHEN 'en' THEN {strip('text')} WHEN 'fr' THEN '\frac{{1' END AS answer FROM documents""",
    "seeded_shuffle": f"SELECT doc_id, text, {order_key('doc_id')} AS order_key FROM documents ORDER BY 3, 1",
    "shuffled_positions": f"""
        SELECT doc_id, text, {order_key('doc_id')} AS order_key,
               row_number() OVER (ORDER BY {order_key('doc_id')}, doc_id) - 1 AS position FROM documents""",
    "sample_cap": f"SELECT doc_id, text, {order_key('doc_id')} AS order_key FROM documents ORDER BY 3, 1 LIMIT {CAP}",
    "sample_cap_top_k": f"SELECT doc_id, text, {order_key('doc_id')} AS order_key FROM documents ORDER BY 3, 1 LIMIT {CAP}",
    "head_cap": f"SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT {CAP}",
    "batch_numbering": f"""
        SELECT *, position // {fixed.GENERATION_BATCH} AS batch_id
        FROM (SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS position FROM conversations)""",
    "union_align": f"""
        SELECT 'documents' AS source, {key('documents', 'doc_id')} AS row_key, doc_id, text, lang,
               NULL::BIGINT AS item_id, NULL::BIGINT AS page_id, NULL::VARCHAR AS url, NULL::VARCHAR AS html FROM documents
        UNION ALL SELECT 'benchmark', {key('benchmark', 'item_id')}, NULL, text, NULL, item_id, NULL, NULL, NULL FROM benchmark
        UNION ALL SELECT 'pages', {key('pages', 'page_id')}, NULL, NULL, NULL, NULL, page_id, url, html FROM pages""",
    "score_join": f"WITH {COMPLETIONS} SELECT prompt_id, gen_idx, source, completion, answer FROM completions JOIN prompts USING (prompt_id)",
    "generation_requests": f"""
        SELECT conv_id, turn, text, CAST(unnest(range({fixed.GENERATIONS_PER_PROMPT})) AS INTEGER) AS gen_idx FROM conversations""",
    "token_count": f"SELECT doc_id, CAST(len(regexp_extract_all(text, {PIECES})) AS INTEGER) AS n_tokens FROM documents",
    "encode_with": """
        WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
        SELECT doc_id, CAST(len(parts) AS INTEGER) AS n_tokens, array_to_string([length(p) FOR p IN parts], ',') AS ids FROM split""",
    "length_filter": f"""
        SELECT * FROM (SELECT doc_id, text, CAST(len(regexp_extract_all(text, {PIECES})) AS INTEGER) AS n_tokens FROM documents)
        WHERE n_tokens <= {MAX_TOKENS}""",
    "length_truncate": f"""
        WITH {encoded('documents', 'doc_id')}
        SELECT doc_id, least(n_tokens, {MAX_TOKENS}) AS n_tokens, {commas(f'ids[1:{MAX_TOKENS}]')} AS ids FROM enc""",
    "build_vocab": f"WITH {encoded('documents', 'doc_id')} SELECT piece, n, id FROM vocab",
    "pad_tokens": f"""
        WITH {encoded('documents', 'doc_id')}
        SELECT doc_id, {padded(fixed.PAD_ID)} AS input_ids, {MASK} AS attention_mask FROM enc""",
    "make_labels": f"WITH {encoded('documents', 'doc_id')} SELECT doc_id, {padded(fixed.IGNORED_LABEL)} AS labels FROM enc",
    "pad_left_batch": f"""
        WITH {encoded('conversations', 'conv_id, turn')},
        batched AS (
          SELECT conv_id, turn, ids[1:{fixed.PROMPT_MAX_TOKENS}] AS ids, least(n_tokens, {fixed.PROMPT_MAX_TOKENS}) AS n,
                 (row_number() OVER (ORDER BY conv_id, turn) - 1) // {fixed.GENERATION_BATCH} AS batch_id FROM enc),
        longest AS (SELECT *, max(n) OVER (PARTITION BY batch_id) - n AS gap FROM batched)
        SELECT conv_id, turn, batch_id,
               {commas(f'list_concat(list_resize([]::INTEGER[], gap, {fixed.PAD_ID}), ids)')} AS input_ids,
               {commas('list_concat(list_resize([]::INTEGER[], gap, 0), list_resize([]::INTEGER[], n, 1))')} AS attention_mask
        FROM longest""",
    "generate_responses": f"""
        WITH {INSTRUCTIONS} SELECT doc_id, {strip("'echo ' || prompt")} AS response, NULL::VARCHAR AS error FROM prompted""",
    "generation_failures": """
        SELECT doc_id, CASE WHEN lang <> 'fr' THEN 'done' END AS response,
               CASE WHEN lang = 'fr' THEN 'ValueError: refused' END AS error FROM documents""",
    "teacher_record": f"""
        WITH {INSTRUCTIONS}
        SELECT instruction, coalesce(input, '') AS input, coalesce(output, '') AS original_output, 'echo' AS teacher_output,
               prompt || 'echo' AS text FROM prompted""",
    "format_reward": f"""
        WITH {COMPLETIONS}, {SCORED} SELECT prompt_id, gen_idx, format_reward FROM scored""",
    "correctness_reward": f"WITH {COMPLETIONS}, {SCORED} SELECT prompt_id, gen_idx, correctness_reward FROM scored",
    "reward_total": f"WITH {COMPLETIONS}, {SCORED} SELECT prompt_id, gen_idx, reward FROM totals",
    "reward_list": f"""
        WITH {COMPLETIONS}, {SCORED},
        parts AS (
          SELECT prompt_id, gen_idx, format_reward AS shape,
                 CASE WHEN gen_idx + 4 * prompt_id <> 7 * ((gen_idx + 4 * prompt_id) // 7) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS boxed
          FROM scored)
        SELECT *, shape + 0.5::DOUBLE * boxed AS reward FROM parts""",
    "group_advantage": f"""
        WITH {COMPLETIONS}, {SCORED}
        SELECT prompt_id, gen_idx, reward, {ADVANTAGE} AS advantage FROM totals WINDOW p AS (PARTITION BY prompt_id)""",
    "reward_report": f"""
        WITH {COMPLETIONS}, {SCORED}
        SELECT source, count(*) AS completions, round(avg(reward), 6) AS mean_reward,
               round(avg((format_reward > 0)::INT), 6) AS share_formatted, round(avg((correctness_reward > 0)::INT), 6) AS share_correct
        FROM totals GROUP BY source""",
    "prep_funnel": f"""
        WITH {REASONING},
        counted AS (
          SELECT source, problem, thinking, solution, len(regexp_extract_all({exchange_text(suffixed('problem'), 'response')}, {PIECES})) AS n_tokens
          FROM answered)
        SELECT source, count(*) AS loaded, count(*) FILTER (WHERE problem = '') AS empty_prompt,
               count(*) FILTER (WHERE problem <> '' AND (thinking <> '' OR solution <> '')) AS formatted,
               count(*) FILTER (WHERE n_tokens > {MAX_TOKENS}) AS too_long, count(*) FILTER (WHERE n_tokens <= {MAX_TOKENS}) AS kept
        FROM counted GROUP BY source""",
    "soft_label_loss": LOSSES,
    "soft_label_loss_wide": LOSSES,
    "soft_label_loss_long": LONG_LOSSES,
    "soft_label_loss_entries": LONG_LOSSES,
    "loss_total_top": f"""
        WITH pairs AS (
          SELECT a.vec_id // 10 AS example_id, a.vec_id % 10 AS pos, a.label, unnest(a.embedding)::DOUBLE AS raw,
                 unnest(b.embedding)::DOUBLE AS teacher, generate_subscripts(a.embedding, 1) - 1 AS token_id
          FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 11 <> 0
        ), kept AS (
          SELECT *, raw / {fixed.LOSS_TEMPERATURE} AS s, teacher / {fixed.LOSS_TEMPERATURE} AS t
          FROM pairs QUALIFY teacher > avg(teacher) OVER (PARTITION BY example_id, pos)
        ), tokens AS (
          SELECT example_id, ln(sum(exp(s))) - sum(exp(t) * s) / sum(exp(t)) AS soft_ce,
                 ln(sum(exp(t))) - sum(exp(t) * t) / sum(exp(t)) AS entropy,
                 ln(sum(exp(raw))) - max(raw) FILTER (WHERE token_id = label) AS hard_ce, label <> 0 AS counted
          FROM kept GROUP BY example_id, pos, label
        ), total AS (
          SELECT count(DISTINCT example_id) AS n_examples, count(*) FILTER (WHERE counted) AS n_tokens,
                 avg(soft_ce) FILTER (WHERE counted) * {fixed.LOSS_TEMPERATURE ** 2} AS soft_ce,
                 avg(soft_ce - entropy) FILTER (WHERE counted) * {fixed.LOSS_TEMPERATURE ** 2} AS kl,
                 coalesce(avg(hard_ce) FILTER (WHERE counted), 0) AS hard_ce
          FROM tokens
        )
        SELECT n_examples, n_tokens, round(soft_ce, 6) AS soft_ce, round(kl, 6) AS kl, round(hard_ce, 6) AS hard_ce,
               round({fixed.LOSS_ALPHA} * soft_ce + {1 - fixed.LOSS_ALPHA} * hard_ce, 6) AS loss FROM total""",
    "loss_total": f"""
        WITH {LOSS}
        SELECT count(*) AS n_examples, sum(n_tokens)::BIGINT AS n_tokens,
               {', '.join(f'round(sum({c} * n_tokens) / sum(n_tokens), 6) AS {c}' for c in ('soft_ce', 'kl', 'hard_ce'))},
               round(sum(({fixed.LOSS_ALPHA} * soft_ce + {1 - fixed.LOSS_ALPHA} * hard_ce) * n_tokens) / sum(n_tokens), 6) AS loss
        FROM per_example""",
    "pending_rows": "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "incremental_format": f"""
        WITH rows AS (
          SELECT source, CAST(doc_id AS VARCHAR) AS row_key,
                 {exchange_text('lang', '(' + response("''", strip('text')) + ')')} AS text FROM documents)
        SELECT *, CAST(len(regexp_extract_all(text, {PIECES})) AS INTEGER) AS n_tokens FROM rows""",
    "logit_training": trained(f"LIMIT {CAP}"),
    "logit_training_all": trained(""),
    "training_funnel": f"""
        WITH {REASONING}, {EXCHANGES}, {training_union(f"LIMIT {CAP}")}
        SELECT 'loaded' AS stage, count(*) AS n_rows FROM united
        UNION ALL SELECT 'capped', count(*) FROM drawn
        UNION ALL SELECT 'kept', count(*) FROM drawn WHERE len(regexp_extract_all(text, {PIECES})) <= {MAX_TOKENS}""",
    "training_funnel_by_source": f"""
        WITH {REASONING}, {EXCHANGES}, {training_union(f"LIMIT {CAP}")},
        counted AS (
          SELECT 'loaded' AS stage, source, count(*) AS n FROM united GROUP BY source
          UNION ALL SELECT 'capped', source, count(*) FROM drawn GROUP BY source
          UNION ALL SELECT 'kept', source, count(*) FROM drawn
          WHERE len(regexp_extract_all(text, {PIECES})) <= {MAX_TOKENS} GROUP BY source)
        SELECT stage, source, coalesce(n, 0) AS n_rows
        FROM (SELECT DISTINCT source FROM united) CROSS JOIN (VALUES ('loaded'), ('capped'), ('kept')) AS s(stage)
        LEFT JOIN counted USING (stage, source)""",
    "supervised_encoded": f"""
        {SUPERVISED}, {encoded('shown', 'source, row_key, order_key', 'documents')}
        SELECT source, row_key, order_key, least(n_tokens, {MAX_TOKENS}) AS n_tokens, {commas(f'ids[1:{MAX_TOKENS}]')} AS ids FROM enc""",
    "prompt_requests": f"""
        WITH {EXCHANGES}
        SELECT row_key, CAST(unnest(range({fixed.GENERATIONS_PER_PROMPT})) AS INTEGER) AS gen_idx,
               {q(fixed.REWARD_SYSTEM)} || chr(10) || chr(10) || problem AS content, solution AS answer FROM exchanges""",
    "source_json_array": f"""
        SELECT 'benchmark' AS source, item_id, text,
               'benchmark:' || md5('{{"item_id":' || item_id || ',"text":' || to_json(text)::VARCHAR || '}}') || ':'
               || lpad('1', 19, '0') AS row_key FROM benchmark""",
    "source_json_array_split": f"SELECT *, {key('documents', 'doc_id')} AS row_key FROM documents",
    "source_json_mixed": f"""
        WITH lines AS (
          SELECT *, doc_id % 50 = 0 AS cut, '{{"doc_id":' || doc_id || ',' AS head FROM documents),
        shown AS (
          SELECT *, CASE
            WHEN cut THEN '{{"doc_id": ' || doc_id
            WHEN lang = 'de' THEN head || '"text":{{"lang":"de"}},"notes":' || to_json(text)::VARCHAR || ',"n_chars":"many"}}'
            WHEN lang NOT IN ('en', 'fr') THEN head || '"text":true,"notes":[["' || lang || '"]],"n_chars":' || n_chars || '.5}}' END AS raw
          FROM lines)
        SELECT 'documents' AS source, CASE WHEN cut THEN 'documents:\\0:' || md5(raw) ELSE {key('documents', 'doc_id')} END AS row_key,
               CASE WHEN NOT cut THEN doc_id END AS doc_id, raw,
               CASE WHEN cut THEN NULL WHEN lang = 'en' THEN text WHEN lang = 'fr' THEN '[' || to_json(text)::VARCHAR || ']'
                    WHEN lang = 'de' THEN '{{"lang":"de"}}' ELSE 'true' END AS text,
               CASE WHEN cut THEN NULL WHEN lang = 'en' THEN lang || '|' || source WHEN lang = 'de' THEN text
                    WHEN lang <> 'fr' THEN '["' || lang || '"]' END AS notes,
               CASE WHEN NOT cut AND lang IN ('en', 'fr') THEN n_chars END AS n_chars,
               CASE WHEN cut THEN NULL WHEN lang IN ('en', 'fr') THEN '' ELSE 'n_chars' END AS misfits
        FROM shown""",
    "sample_cap_json": f"""
        WITH rows AS (
          SELECT 'train' AS source, {content_key('train', 'text')} AS row_key, text FROM documents
          UNION ALL SELECT 'train-2', {content_key('train-2', 'html')}, html FROM pages)
        SELECT *, {order_key('row_key')} AS order_key FROM rows ORDER BY 4, 2 LIMIT {CAP}""",
    "multi_source_same_name": f"""
        SELECT 'train' AS source, {key('train', 'doc_id')} AS row_key, text FROM documents
        UNION ALL SELECT 'train-2', {key('train-2', 'item_id')}, text FROM benchmark""",
    "teacher_job": f"""
        WITH {INSTRUCTIONS},
        numbered AS (
          SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {fixed.GENERATION_BATCH} AS batch
          FROM (SELECT * FROM prompted ORDER BY doc_id LIMIT {CAP}))
        SELECT instruction, coalesce(input, '') AS input, coalesce(output, '') AS original_output, 'echo' AS teacher_output,
               prompt || 'echo' AS text, NULL::BIGINT AS doc_id, NULL::BIGINT AS batch_id, NULL::VARCHAR AS error
        FROM numbered WHERE instruction <> 'Write in fr'
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, doc_id, batch, 'ValueError: refused'
        FROM numbered WHERE instruction = 'Write in fr'""",
    "teacher_resume": f"""
        WITH {INSTRUCTIONS},
        answered AS (
          SELECT *, CASE WHEN doc_id % 2 = 0 AND instruction <> 'Write in fr' THEN 'first' ELSE 'second' END AS answer FROM prompted)
        SELECT instruction, coalesce(input, '') AS input, coalesce(output, '') AS original_output, answer AS teacher_output,
               prompt || answer AS text FROM answered""",
    "addressable_shuffle": addressable(),
    "positional_zip": """
        SELECT doc_id, d.text AS text, conv_id, turn, role FROM documents d POSITIONAL JOIN conversations
        WHERE doc_id IS NOT NULL AND conv_id IS NOT NULL""",
    "positional_zip_padded": """
        SELECT doc_id, text, page_id, url, html FROM documents POSITIONAL JOIN pages""",
    "group_advantage_heavy": f"""
        WITH {COMPLETIONS}, {SCORED}
        SELECT source, prompt_id, gen_idx, {ADVANTAGE} AS advantage FROM totals WINDOW p AS (PARTITION BY source)""",
    "score_join_heavy": f"""
        WITH {COMPLETIONS}, sources AS (SELECT source, max(doc_id) AS answer FROM documents GROUP BY source)
        SELECT source, prompt_id, gen_idx, completion, sources.answer FROM completions JOIN sources USING (source)""",
    "supervised": f"""
        WITH {REASONING}, {EXCHANGES},
        united AS (
          SELECT source, row_key, problem, thinking, solution FROM normal
          UNION ALL SELECT source, row_key, {strip('problem')}, '', {strip('solution')} FROM exchanges)
        SELECT source, row_key, {exchange_text('problem', '(' + response('thinking', 'solution') + ')')} AS text,
               {order_key('row_key')} AS order_key FROM united""",
    "reward_scoring": f"""
        WITH {COMPLETIONS}, {SCORED}
        SELECT prompt_id, gen_idx, source, format_reward, correctness_reward, reward, {ADVANTAGE} AS advantage
        FROM totals WINDOW p AS (PARTITION BY prompt_id)""",
}
