"""The registered queries: every operator over whole tables.

The tables hold no reasoning columns, tags or boxed answers. The recipes below put them around whole texts,
row by row, so that each operator meets all its cases and its work grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from lectern import fixed
from lectern.functions import rewards, text as tx
from lectern.operators import combine, conversations, formats, funnel, generate, permutation, positions, resume, sampling, scoring, softloss, tokens
from lectern.plans import prepare, score, teacher
from lectern.session import scratch_path
from lectern.sources.load import SourceSpec, load_source, load_sources
from lectern.sources.sinks import write_json_arrays, write_jsonl, write_shards
from lectern.streaming.incremental import run_incremental

Query = Callable[[SparkSession, str], DataFrame]

SOURCES = [("documents", "doc_id"), ("benchmark", "item_id"), ("pages", "page_id")]
VOCABULARY = 1000
MAX_TOKENS = 512
CAP = 400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spec(sf_dir: str, name: str, key: str) -> SourceSpec:
    return SourceSpec(f"{sf_dir}/{name}.parquet", name=name, key=key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def joined_text(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), ",").alias(ids)


# --- Recipes -----------------------------------------------------------------------------------------


def reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reasoning rows: blank problems, missing thinking, generations with and without tags."""
    text, lang = F.col("text"), F.col("lang")
    return load_source(spark, spec(sf_dir, "documents", "doc_id")).select(
        F.col("own_source").alias("source"),
        "row_key",
        "doc_id",
        F.when(lang == "fr", F.lit("  ")).otherwise(F.concat(F.lit(" "), text, F.lit(" "))).alias("problem"),
        F.when(lang == "fr", F.concat(F.lit("\t"), text, F.lit("\n"))).otherwise(F.lit("unused")).alias("question"),
        F.when(lang == "de", text).when(lang != "es", F.lit(" ")).alias("thinking"),
        F.when(lang == "en", F.array(F.concat(F.lit("<THINK>\n"), text, F.lit(" </think> tail <think>b</think>")), F.lit("c")))
        .when(lang == "es", F.array(text))
        .when(lang == "de", F.array(F.lit("<think>unused</think>")))
        .alias("generations"),
        F.when(F.col("own_source") != "src0", F.concat(F.lit("so \\boxed{"), F.col("doc_id").cast("string"), F.lit("} ")))
        .alias("solution"),
    )


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows them."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("problem"))
    told = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("solution")
    )
    return asked.join(told, ["conv_id", "turn"]).select(
        F.lit("conversations").alias("source"),
        F.concat_ws(":", F.lit("conversations"), *[F.lpad(F.col(c).cast("string"), 19, "0") for c in ("conv_id", "turn")]).alias(
            "row_key"
        ),
        "problem",
        "solution",
    )


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("Write in "), "lang").alias("instruction"),
        F.when(F.col("lang") == "es", F.lit(" 　")).when(F.col("lang") != "de", text).alias("input"),
        F.when(F.col("lang") != "fr", text).alias("output"),
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id, text = F.col("doc_id"), F.col("text")
    block = (
        F.when(doc_id % 5 == 0, F.concat(F.lit("</reasoning>"), text, F.lit("<reasoning>")))
        .when(doc_id % 5 == 1, F.concat(F.lit("<reasoning>"), text))
        .otherwise(F.concat(F.lit("<reasoning>\n "), text, F.lit(" \n</reasoning>")))
    )
    result = F.when(doc_id % 7 == 0, F.lit(" no box")).otherwise(
        F.concat(F.lit(" \\boxed{1} \\boxed{ "), (doc_id % 3).cast("string"), F.lit(" }"))
    )
    return table(spark, sf_dir, "documents").select(
        F.expr("doc_id div 4").alias("prompt_id"),
        (doc_id % 4).cast("int").alias("gen_idx"),
        "source",
        F.concat(block, result).alias("completion"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("prompt_id")).distinct()
    return ids.withColumn("answer", F.concat(F.lit("so \\boxed{"), (F.col("prompt_id") % 3).cast("string"), F.lit("}")))


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return tokens.encode_with_vocab(docs, tokens.build_vocab(docs, VOCABULARY)).drop("text")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors as student and teacher, ten positions to an example, class 0 ignored."""
    vectors = table(spark, sf_dir, "embeddings")
    teachers = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("teacher"))
    return vectors.join(teachers, "vec_id").select(
        F.expr("vec_id div 10").alias("example_id"),
        (F.col("vec_id") % 10).cast("int").alias("pos"),
        F.when(F.col("label") == 0, F.lit(fixed.IGNORED_LABEL)).otherwise(F.col("label")).alias("label"),
        F.col("embedding").alias("student"),
        # A wider vocabulary on the teacher's side, and now and then a position without logits.
        F.when(F.col("vec_id") % 11 == 0, F.array().cast("array<float>"))
        .otherwise(F.concat("teacher", F.array(F.lit(9.0).cast("float"))))
        .alias("teacher"),
    )


# --- Sources and sinks -------------------------------------------------------------------------------


def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "documents-json")
    docs = table(spark, sf_dir, "documents")
    write_jsonl(docs, path)
    rows = load_source(spark, SourceSpec(path, name="documents", format="json", schema=docs.schema, key="doc_id"))
    return rows.select("source", "row_key", "doc_id", "text", "lang", "n_chars")


def source_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark as JSON arrays without a key: rows are known by their content."""
    path = scratch_path(spark, "benchmark-array")
    items = table(spark, sf_dir, "benchmark")
    write_json_arrays(items, path)
    return load_source(spark, SourceSpec(path, name="benchmark", format="json", schema=items.schema, json_array=True))


def source_json_array_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON arrays, each read by as many tasks as it has splits."""
    path = scratch_path(spark, "documents-array")
    docs = table(spark, sf_dir, "documents")
    write_json_arrays(docs, path)
    spec = SourceSpec(path, name="documents", format="json", schema=docs.schema, json_array=True, key="doc_id")
    return load_source(spark, spec).drop("source").withColumnRenamed("own_source", "source")


def source_json_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines whose rows disagree on the type of every field; some lines are cut off."""
    path, doc_id, lang = scratch_path(spark, "documents-mixed"), F.col("doc_id"), F.col("lang")
    text, number = F.col("text"), F.col("n_chars")
    plain = F.struct("doc_id", "text", F.array("lang", "source").alias("notes"), "n_chars")
    quoted = F.struct(doc_id.cast("string").alias("doc_id"), F.array("text").alias("text"), "source", number.cast("string").alias("n_chars"))
    odd = F.struct("doc_id", F.struct("lang").alias("text"), text.alias("notes"), F.lit("many").alias("n_chars"))
    partial = F.struct("doc_id", F.lit(True).alias("text"), F.array(F.array("lang")).alias("notes"), (number + 0.5).alias("n_chars"))
    line = (
        F.when(doc_id % 50 == 0, F.concat(F.lit('{"doc_id": '), doc_id.cast("string")))
        .when(lang == "en", F.to_json(plain))
        .when(lang == "fr", F.to_json(quoted))
        .when(lang == "de", F.to_json(odd))
        .otherwise(F.to_json(partial))
    )
    table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    schema = "doc_id bigint, text string, notes array<string>, n_chars bigint"
    rows = load_source(spark, SourceSpec(path, name="documents", format="json", schema=schema, key="doc_id", mixed=True))
    notes, misfits = F.array_join("notes", "|"), F.array_join("misfits", "|")
    return rows.select("source", "row_key", "doc_id", "text", notes.alias("notes"), "n_chars", misfits.alias("misfits"), "raw")


def sample_cap_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cap over two JSON sources without keys and of one name."""
    paths = [scratch_path(spark, name) for name in ("documents", "pages")]
    docs, pages = table(spark, sf_dir, "documents").select("text"), table(spark, sf_dir, "pages").select(F.col("html").alias("text"))
    for df, path in zip((docs, pages), paths, strict=True):
        write_jsonl(df, path)
    specs = [SourceSpec(path, name="train", format="json", schema=docs.schema) for path in paths]
    return sampling.sample_cap(combine.union_all(load_sources(spark, specs)), CAP, unique=True)


def multi_source_same_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables under one name: keys stay apart."""
    specs = [SourceSpec(f"{sf_dir}/{name}.parquet", name="train", key=key) for name, key in SOURCES[:2]]
    return combine.union_all([t.select("source", "row_key", "text") for t in load_sources(spark, specs)])


def source_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_source(spark, spec(sf_dir, "documents", "doc_id"))


def multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark, pages = load_sources(spark, [spec(sf_dir, name, key) for name, key in SOURCES])
    shaped = [
        documents.withColumns({"problem": F.concat(F.lit("Write in "), "lang"), "solution": F.col("text")}),
        benchmark.withColumnRenamed("text", "question"),
        pages.withColumnsRenamed({"url": "problem", "html": "solution"}),
    ]
    rows = prepare.formatted_union(shaped, instruction=True, generations=True)
    return prepare.render_exchanges(rows).drop("empty_prompt", "empty_response")


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    rows = formats.teacher_prompt(instructions(spark, sf_dir)).withColumn("response", F.col("output"))
    records = rows.select("doc_id", "instruction", "input", "output", "response")
    write_jsonl(records, path)
    return spark.read.schema(records.schema).json(path)


def training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    rows = sampling.with_order_key(encoded_documents(spark, sf_dir), "doc_id")
    kept = tokens.length_filter(rows, MAX_TOKENS)
    write_shards(kept, path, row_key="doc_id", max_tokens=MAX_TOKENS)
    columns = [joined_text(c) for c in ("input_ids", "attention_mask", "labels")]
    return spark.read.parquet(path).select("order_key", "doc_id", "n_tokens", *columns)


# --- Formatting --------------------------------------------------------------------------------------


def normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.normalize_columns(reasoning(spark, sf_dir)).select("doc_id", "problem", "thinking", "solution")


def instruction_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.add_instruction(formats.normalize_columns(reasoning(spark, sf_dir))).select("doc_id", "problem")


def extract_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formats.normalize_columns(reasoning(spark, sf_dir))
    return formats.thinking_from_generations(rows).select("doc_id", "thinking")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formats.normalize_columns(reasoning(spark, sf_dir))
    return formats.assemble_response(formats.thinking_from_generations(rows))


def assemble_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _responses(spark, sf_dir).select("doc_id", "response")


def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formats.build_messages(_responses(spark, sf_dir))
    return rows.select("doc_id", F.posexplode("messages").alias("idx", "m")).select("doc_id", "idx", "m.role", "m.content")


def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.render_conversations(table(spark, sf_dir, "conversations"))


def teacher_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.teacher_prompt(instructions(spark, sf_dir)).select("doc_id", "prompt")


def rl_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = load_sources(spark, [spec(sf_dir, name, key) for name, key in SOURCES[:2]])
    asked = documents.select("source", "row_key", F.col("lang").alias("question"), F.col("text").alias("answer"))
    rows = combine.union_all(
        [
            formats.reward_format(t).select("source", "row_key", "prompt", "answer")
            for t in (exchanges(spark, sf_dir), asked, benchmark)
        ]
    )
    message = F.get("prompt", F.lit(0))
    return rows.select("source", "row_key", message["role"].alias("role"), message["content"].alias("content"), "answer")


def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.with_order_key(table(spark, sf_dir, "documents"), "doc_id")
    return formats.preview(rows, ["order_key", "doc_id"])


# --- Extraction --------------------------------------------------------------------------------------


def strip_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = F.concat(F.lit("\u001c\u0085  "), "text", F.lit("　\n\t "))
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_unicode(framed).alias("text"))


def extract_tagged_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, lang = F.col("text"), F.col("lang")
    tagged = (
        F.when(lang == "fr", F.concat(F.lit("<answer>a</answer><answer> "), text, F.lit(" </answer> after")))
        .when(lang == "de", F.concat(F.lit("<answer>"), text))
        .otherwise(F.concat(F.lit(" "), text))
    )
    return table(spark, sf_dir, "documents").select("doc_id", tx.tagged_answer(tagged).alias("answer"))


def extract_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxed = F.concat(F.lit("\\boxed{1} \\boxed{ "), "text", F.lit(" } \\frac{1}{2}"))
    nested = F.concat("text", F.lit(" \\boxed{\\frac{1}{2}}"))
    value = F.when(F.col("lang") == "en", boxed).when(F.col("lang") == "fr", nested).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.boxed_answer(value).alias("answer"))


# --- Order, caps, numbering --------------------------------------------------------------------------


def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def shuffled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.number_shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_cap(table(spark, sf_dir, "documents").select("doc_id", "text"), CAP, "doc_id")


def sample_cap_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_cap(table(spark, sf_dir, "documents").select("doc_id", "text"), CAP, "doc_id", top_k=True)


def head_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.head_cap(table(spark, sf_dir, "documents").select("doc_id", "text"), CAP, ["doc_id"])


def batch_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return sampling.batch_numbering(turns, ["conv_id", "turn"])


# --- Unions, joins, fan-out --------------------------------------------------------------------------


def union_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark, pages = load_sources(spark, [spec(sf_dir, name, key) for name, key in SOURCES])
    return combine.union_align([documents.drop("n_chars", "own_source"), benchmark, pages])


def score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_join(completions(spark, sf_dir), prompts(spark, sf_dir))


def generation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return combine.generation_requests(turns)


# --- Tokens ------------------------------------------------------------------------------------------


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_count(documents(spark, sf_dir)).drop("text")


def encode_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's encoder: here, the length of every line."""

    def load_encoder():
        return lambda texts: [[len(line) for line in text.split("\n")] for text in texts]

    rows = tokens.encode_with(documents(spark, sf_dir), load_encoder)
    return rows.select("doc_id", "n_tokens", joined_text("ids"))


def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.token_count(documents(spark, sf_dir))
    return tokens.length_filter(rows, MAX_TOKENS)


def length_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.length_truncate(encoded_documents(spark, sf_dir), MAX_TOKENS)
    return rows.select("doc_id", "n_tokens", joined_text("ids"))


def build_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.build_vocab(documents(spark, sf_dir), VOCABULARY)


def pad_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.pad_tokens(encoded_documents(spark, sf_dir), MAX_TOKENS)
    return rows.select("doc_id", joined_text("input_ids"), joined_text("attention_mask"))


def make_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.pad_tokens(encoded_documents(spark, sf_dir), MAX_TOKENS)
    return tokens.make_labels(rows).select("doc_id", joined_text("labels"))


def pad_left_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    encoded = tokens.encode_with_vocab(turns, tokens.build_vocab(turns, VOCABULARY)).drop("text")
    batches = sampling.batch_numbering(encoded, ["conv_id", "turn"])
    rows = tokens.pad_left_batch(batches)
    return rows.select("conv_id", "turn", "batch_id", joined_text("input_ids"), joined_text("attention_mask"))


# --- Generation --------------------------------------------------------------------------------------


def generate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    def load_echo():
        return lambda batch: [f" echo {prompt}" for prompt in batch]

    rows = formats.teacher_prompt(instructions(spark, sf_dir)).select("doc_id", "prompt")
    return generate.generate_responses(rows, load_echo).select("doc_id", "response", "error")


def generation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four, of which those that hold a row in one language fail: only these rows do in the end."""

    def load_choosy():
        def run(batch):
            if any("Write in fr" in prompt for prompt in batch):
                raise ValueError("refused")
            return ["done "] * len(batch)

        return run

    rows = formats.teacher_prompt(instructions(spark, sf_dir)).select("doc_id", "prompt")
    generated = generate.generate_responses(rows, load_choosy, batch_size=4)
    path = scratch_path(spark, "generated")
    generate.write_generated(generated, path)
    return spark.read.schema(generated.schema).parquet(path).select("doc_id", "response", "error")


def teacher_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    def load_echo():
        return lambda batch: ["echo"] * len(batch)

    generated = teacher.teacher_rows(instructions(spark, sf_dir), load_echo, order=("doc_id",))
    return teacher.teacher_records(generated)


def teacher_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: the records it wrote, and the rows it put apart with their batch and error."""

    def load_choosy():
        def run(batch):
            if any("Write in fr" in prompt for prompt in batch):
                raise ValueError("refused")
            return ["echo"] * len(batch)

        return run

    path = scratch_path(spark, "teacher")
    teacher.teacher_job(instructions(spark, sf_dir), load_choosy, path, max_samples=CAP, order=("doc_id",))
    schema = "instruction string, input string, original_output string, teacher_output string, text string"
    records = spark.read.schema(schema).json(f"{path}/records")
    return combine.union_align([records, spark.read.parquet(f"{path}/quarantine")])


def teacher_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the job over all rows; the first ends half-way, the second asks the rest and what had failed."""

    def load_first():
        def run(batch):
            if any("Write in fr" in prompt for prompt in batch):
                raise ValueError("refused")
            return ["first"] * len(batch)

        return run

    def load_second():
        return lambda batch: ["second"] * len(batch)

    path, rows = scratch_path(spark, "teacher"), instructions(spark, sf_dir)
    half = rows.where(F.col("doc_id") % 2 == 0)
    teacher.teacher_job(half, load_first, path, order=("doc_id",), compression="gzip")
    teacher.teacher_job(rows, load_second, path, order=("doc_id",), ask_failed_again=True, compression="gzip")
    schema = "instruction string, input string, original_output string, teacher_output string, text string"
    return spark.read.schema(schema).json(f"{path}/records")


def addressable_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a shuffle that no sort makes, and the position that the place leads back to."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = docs.count()
    numbered = sampling.number_ordered(docs, ["doc_id"])
    placed = numbered.withColumn("place", permutation.place_of(F.col("position"), F.lit(n)))
    return placed.withColumn("back", permutation.position_of(F.col("place"), F.lit(n)))


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    return positions.zip_rows(docs.select("doc_id", "text"), turns.select("conv_id", "turn", "role")).drop("position")


def positional_zip_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    return positions.zip_rows(docs.select("doc_id", "text"), pages, padded=True).drop("position")


# --- Scoring -----------------------------------------------------------------------------------------


def format_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat_form = completions(spark, sf_dir).withColumn(
        "completion", F.array(F.struct(F.lit("assistant").alias("role"), F.col("completion").alias("content")))
    )
    return scoring.with_format_reward(chat_form).drop("completion", "source")


def correctness_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.score_join(completions(spark, sf_dir), prompts(spark, sf_dir))
    return scoring.with_correctness_reward(rows).select("prompt_id", "gen_idx", "correctness_reward")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.score_completions(completions(spark, sf_dir), prompts(spark, sf_dir), keep=["source"])
    return scoring.total_reward(rows)


def reward_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("prompt_id", "gen_idx", "reward")


def reward_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own list of weighted reward functions."""
    specs = [
        ("shape", 1.0, rewards.format_reward),
        ("boxed", 0.5, lambda text: F.when(tx.boxed_answer(text).isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))),
    ]
    return scoring.apply_rewards(completions(spark, sf_dir), specs).select("prompt_id", "gen_idx", "shape", "boxed", "reward")


def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "scores")
    _scored(spark, sf_dir).write.parquet(path)
    rows = scoring.group_advantage(spark.read.parquet(path))
    return rows.select("prompt_id", "gen_idx", "reward", (F.round("advantage", 6) + F.lit(0.0)).alias("advantage"))


def group_advantage_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by source, all of which hold more rows than one task is allowed here."""
    path = scratch_path(spark, "scores")
    _scored(spark, sf_dir).write.parquet(path)
    rows = scoring.group_advantage(spark.read.parquet(path), prompt_id="source", rows_per_salt=5)
    return rows.select("source", "prompt_id", "gen_idx", (F.round("advantage", 6) + F.lit(0.0)).alias("advantage"))


def score_join_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join by source, with several salts to each."""
    sources = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").alias("answer"))
    return scoring.score_join(completions(spark, sf_dir), sources, prompt_id="source", rows_per_salt=7)


def reward_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = scoring.reward_report(_scored(spark, sf_dir))
    shares = [F.round(c, 6).alias(c) for c in ("mean_reward", "share_formatted", "share_correct")]
    return report.select("source", "completions", *shares)


def prep_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.formatted_union([reasoning(spark, sf_dir)], instruction=True, generations=True)
    counted = tokens.token_count(prepare.render_exchanges(rows))
    return funnel.prep_funnel(counted, MAX_TOKENS)


def training_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the whole job after each of its stages."""
    sources = _training_sources(spark, sf_dir)
    capped = sampling.sample_cap(prepare.formatted_union(sources, instruction=True, generations=True), CAP, unique=True)
    kept = tokens.length_filter(tokens.token_count(prepare.render_exchanges(capped)), MAX_TOKENS)
    stages = {"loaded": prepare.formatted_union(sources, instruction=True, generations=True), "capped": capped, "kept": kept}
    return combine.union_all([df.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n_rows")) for name, df in stages.items()])


def training_funnel_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each source, counted as the rows are written: the job runs once."""
    seen = {stage: Observation() for stage in ("loaded", "capped", "kept")}
    rows = prepare.logit_training_rows(
        _training_sources(spark, sf_dir), tokens.token_count, max_samples=CAP, max_tokens=MAX_TOKENS, by_source=seen
    )
    rows.write.parquet(scratch_path(spark, "training-rows"))
    return funnel.group_counts(spark, seen)


def _rounded_losses(losses: DataFrame) -> DataFrame:
    columns = [F.round(c, 6).alias(c) for c in ("soft_ce", "kl", "hard_ce", "loss")]
    return losses.select("example_id", "n_tokens", "n_refused", *columns)


def soft_label_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_losses(softloss.soft_label_loss(logits(spark, sf_dir)))


def soft_label_loss_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_losses(softloss.soft_label_loss(logits(spark, sf_dir), wide_vocabulary=True))


def _logit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = logits(spark, sf_dir).where(F.size("teacher") > 0)
    pairs = pairs.withColumn("e", F.arrays_zip("student", F.slice("teacher", 1, F.size("student")).alias("teacher")))
    return pairs.select("example_id", "pos", "label", F.posexplode("e").alias("token_id", "e")).select(
        "example_id", "pos", "label", "token_id", "e.student", "e.teacher"
    )


def soft_label_loss_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_losses(softloss.soft_label_loss(softloss.pack_logits(_logit_entries(spark, sf_dir))))


def soft_label_loss_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without gathering any distribution."""
    return _rounded_losses(softloss.soft_label_loss_of_entries(_logit_entries(spark, sf_dir)))


def loss_total_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the entries of each position only those above its mean are kept, so many labels have no hard loss."""
    entries = _logit_entries(spark, sf_dir)
    mean = F.avg("teacher").over(Window.partitionBy("example_id", "pos"))
    kept = entries.withColumn("mean", mean).where(F.col("teacher") > F.col("mean")).drop("mean")
    total = softloss.loss_total(softloss.soft_label_loss_of_entries(kept, unique=True))
    return total.select("n_examples", "n_tokens", *[F.round(c, 6).alias(c) for c in ("soft_ce", "kl", "hard_ce", "loss")])


def loss_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = softloss.loss_total(softloss.soft_label_loss(logits(spark, sf_dir)))
    return total.select("n_examples", "n_tokens", *[F.round(c, 6).alias(c) for c in ("soft_ce", "kl", "hard_ce", "loss")])


# --- Resuming ----------------------------------------------------------------------------------------


def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resume.pending_rows(inputs, table(spark, sf_dir, "labels"), "doc_id")


def incremental_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "incremental")

    def rows(docs: DataFrame) -> DataFrame:
        shaped = docs.select(
            "source", F.col("doc_id").cast("string").alias("row_key"), F.col("lang").alias("problem"), F.col("text").alias("solution")
        )
        formatted = formats.format_exchange(shaped, instruction=False, generations=False)
        return tokens.token_count(prepare.render_exchanges(formatted)).drop("empty_prompt", "empty_response")

    docs = table(spark, sf_dir, "documents")
    # A stream takes a file, or a folder of them, only by a pattern; this one matches no other name.
    path = f"{sf_dir}/{{documents.parquet}}"
    run = run_incremental(spark, path, docs.schema, rows, f"{out}/rows", f"{out}/checkpoint")
    run.awaitTermination()
    # A folder without files gives no batch and so no file to take a schema from.
    return spark.read.schema(rows(docs).schema).parquet(f"{out}/rows")


# --- Whole jobs --------------------------------------------------------------------------------------


def _training_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three differently shaped sources. The joined one is written once: a cap reads keys before it reads texts."""
    path = scratch_path(spark, "exchanges")
    exchanges(spark, sf_dir).write.parquet(path)
    benchmark = load_source(spark, spec(sf_dir, "benchmark", "item_id")).withColumnRenamed("text", "question")
    return [reasoning(spark, sf_dir), spark.read.parquet(path), benchmark]


def _logit_training(spark: SparkSession, sf_dir: str, cap: int | None) -> DataFrame:
    vocabulary = tokens.build_vocab(documents(spark, sf_dir), VOCABULARY)
    rows = prepare.logit_training_rows(
        _training_sources(spark, sf_dir), lambda df: tokens.encode_with_vocab(df, vocabulary), max_samples=cap, max_tokens=MAX_TOKENS
    )
    padded = tokens.make_labels(tokens.pad_tokens(rows, MAX_TOKENS))
    columns = [joined_text(c) for c in ("input_ids", "attention_mask", "labels")]
    return padded.select("source", "row_key", "order_key", "n_tokens", *columns)


def logit_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped, rendered, encoded once, filtered and padded."""
    return _logit_training(spark, sf_dir, CAP)


def logit_training_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all rows."""
    return _logit_training(spark, sf_dir, None)


def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.supervised_rows([reasoning(spark, sf_dir), exchanges(spark, sf_dir)])


def supervised_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources, encoded and cut to length."""
    vocabulary = tokens.build_vocab(documents(spark, sf_dir), VOCABULARY)
    rows = prepare.supervised_rows(
        _training_sources(spark, sf_dir), lambda df: tokens.encode_with_vocab(df, vocabulary), max_tokens=MAX_TOKENS
    )
    return rows.select("source", "row_key", "order_key", "n_tokens", joined_text("ids"))


def prompt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward prompts with their gold answers, each as often as completions are wanted."""
    requests = score.prompt_requests(exchanges(spark, sf_dir))
    return requests.select("row_key", "gen_idx", F.get("prompt", F.lit(0))["content"].alias("content"), "answer")


def reward_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "scored")
    rows = score.scored_groups(completions(spark, sf_dir), prompts(spark, sf_dir), path, keep=["source"])
    return rows.withColumn("advantage", F.round("advantage", 6) + F.lit(0.0))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        source_json,
        source_json_array,
        source_json_array_split,
        source_json_mixed,
        source_parquet,
        multi_source,
        multi_source_same_name,
        jsonl_roundtrip,
        training_shards,
        normalize_columns,
        instruction_suffix,
        extract_thinking,
        assemble_response,
        build_messages,
        chat_render,
        teacher_prompt,
        rl_format,
        preview,
        strip_unicode,
        extract_tagged_answer,
        extract_boxed,
        seeded_shuffle,
        shuffled_positions,
        sample_cap,
        sample_cap_top_k,
        sample_cap_json,
        head_cap,
        batch_numbering,
        union_align,
        score_join,
        score_join_heavy,
        generation_requests,
        token_count,
        encode_with,
        length_filter,
        length_truncate,
        build_vocab,
        pad_tokens,
        make_labels,
        pad_left_batch,
        generate_responses,
        generation_failures,
        teacher_record,
        teacher_job,
        teacher_resume,
        addressable_shuffle,
        positional_zip,
        positional_zip_padded,
        format_reward,
        correctness_reward,
        reward_total,
        reward_list,
        group_advantage,
        group_advantage_heavy,
        reward_report,
        prep_funnel,
        training_funnel,
        training_funnel_by_source,
        soft_label_loss,
        soft_label_loss_wide,
        soft_label_loss_long,
        soft_label_loss_entries,
        loss_total_top,
        loss_total,
        pending_rows,
        incremental_format,
        logit_training,
        logit_training_all,
        supervised,
        supervised_encoded,
        reward_scoring,
        prompt_requests,
    )
}
