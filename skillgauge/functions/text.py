"""Text functions (H4, H5, H9-H15, H18, H20, H21) and seeded hashes."""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Markers of the chat text format.
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>"

# Text put before a capability when it is embedded, by dataset family.
EMBEDDING_PREFIX = {
    "skill": "The model has the following skill or capability: ",
    "capability": "The model has the following capability: ",
}

# Task suffix of mathematical training prompts.
MATH_SUFFIX = "\nPlease reason step by step, and put your final answer within \\boxed{}."

# Words, else single marks; the default token rule.
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def lines(text: Column) -> Column:
    """The stripped, non-blank lines of a text."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def short_model_name(model: Column) -> Column:
    """H4: the part of a model name after the last slash."""
    return F.substring_index(model, "/", -1)


def file_stem(path: Column) -> Column:
    """H4: file name without folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"^(.+)\.[^.]+$", "$1")


def safe_file_name(name: Column) -> Column:
    """H4: slashes and dots become underscores."""
    return F.translate(name, "/.", "__")


def configuration_label(model: Column, language: Column, shots: Column, benchmark: Column) -> Column:
    """H4: `model_language_Nshot_benchmark`."""
    return F.concat_ws(
        "_", short_model_name(model), language, F.concat(shots.cast("string"), F.lit("shot")), file_stem(benchmark)
    )


def question_text(prompt: Column) -> Column:
    """H5: what stands between the first and second `Question:`, up to the first blank line.

    Null unless the prompt starts with `Question:`.
    """
    body = strip(F.substring_index(F.substring_index(prompt, "Question:", 2), "Question:", -1))
    return F.when(prompt.startswith("Question:"), strip(F.substring_index(body, "\n\n", 1)))


def json_object_text(text: Column) -> Column:
    """H9: the span from the first `{` to the last `}`, null when there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def scoring_map(text: Column) -> Column:
    """H9: JSON object in free text as a map to the raw JSON of each value; null if unparsable."""
    return F.from_json(json_object_text(text), "map<string,string>")


def score_or_default(scores: Column, key: Column | str, default: float = 1.0) -> Column:
    """The number under `score` of one entry, `default` when missing or not a number."""
    entry = F.try_element_at(scores, key if isinstance(key, Column) else F.lit(key))
    return F.coalesce(F.get_json_object(entry, "$.score").try_cast("double"), F.lit(float(default)))


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Fill `{name}` fields. The template is cut when the plan is built, so a value that
    itself contains `{other}` is never expanded, and `{{` stands for one brace."""
    pieces = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(values[field].cast("string"))
    return F.concat(*pieces) if pieces else F.lit("")


def replace_template(template: Column | str, values: Mapping[str, Column]) -> Column:
    """H12, brace-safe form: replace the listed fields one after another, leave other braces alone."""
    text = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def chat_messages(text: Column) -> Column:
    """Chat text to `array<struct<role, content, attributes>>`, null if not framed by markers."""
    framed = strip(text)

    def message(turn: Column) -> Column:
        head = strip(F.substring_index(turn, "\n", 1))
        body = F.substring(turn, F.instr(turn, "\n") + 1, F.length(turn))
        tagged = head.startswith("system") & (head != "system")
        pairs = F.filter(F.split(F.substring(head, F.lit(7), F.length(head)), " "), lambda pair: pair != "")
        attributes = F.map_from_entries(
            F.transform(
                pairs,
                lambda pair: F.struct(
                    F.substring_index(pair, "=", 1).alias("key"),
                    F.substring(pair, F.instr(pair, "=") + 1, F.length(pair)).alias("value"),
                ),
            )
        )
        return F.struct(
            F.when(tagged, F.lit("system")).otherwise(head).alias("role"),
            strip(F.substring_index(body, TURN_END, 1)).alias("content"),
            F.when(tagged, attributes).alias("attributes"),
        )

    turns = F.split(framed, r"<\|im_start\|>")
    return F.when(
        framed.startswith(TURN_START) & framed.endswith(TURN_END),
        F.transform(F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0))), message),
    )


def ratio_label(part: Column, whole: Column) -> Column:
    """`"a / b = 0.ddddd"`, ratio 0 for an empty set."""
    ratio = F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    return F.format_string("%d / %d = %.5f", part.cast("bigint"), whole.cast("bigint"), F.bround(ratio, 5))


def first_message_key(text: Column, length: int | None = None) -> Column:
    """Key under which first messages count as the same: stripped, lower case, optionally cut."""
    key = F.lower(strip(text))
    return key if length is None else F.substring(key, 1, length)


def token_count(text: Column) -> Column:
    """Number of tokens by the default rule; pass a pandas UDF of your own where a model's tokenizer counts."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def training_messages(prompt: Column, response: Column | None = None, suffix: str = MATH_SUFFIX) -> Column:
    """User turn with the task suffix and, if given, the assistant turn."""
    turns = [F.struct(F.lit("user").alias("role"), F.concat(prompt, F.lit(suffix)).alias("content"))]
    if response is not None:
        turns.append(F.struct(F.lit("assistant").alias("role"), response.alias("content")))
    return F.array(*turns)


def render_messages(messages: Column) -> Column:
    """Messages as chat text."""
    return F.array_join(
        F.transform(
            messages, lambda m: F.concat(F.lit(TURN_START), m["role"], F.lit("\n"), m["content"], F.lit(TURN_END))
        ),
        "\n",
    )


def fix_output(output: Column, dataset: Column, newline_first: tuple[str, ...] = ("DS-1000",)) -> Column:
    """Outputs of the listed datasets start on a new line."""
    return F.when(dataset.isin(*newline_first), F.concat(F.lit("\n"), output)).otherwise(output)


def embedding_text(capability: Column, family: str = "capability") -> Column:
    """Capability with the prefix of its dataset family."""
    return F.concat(F.lit(EMBEDDING_PREFIX[family]), capability)


def seeded_hash(seed: int | Column, *keys: Column) -> Column:
    """Order key of every seeded shuffle and sample: the same rows give the same order under any
    partitioning, and any SQL engine can recompute it."""
    start = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws(":", start.cast("string"), *[key.cast("string") for key in keys]))


def seeded_uniform(seed: int | Column, *keys: Column) -> Column:
    """A uniform draw in [0, 1) that depends only on the seed and the keys."""
    bits = F.conv(F.substring(seeded_hash(seed, *keys), 1, 13), 16, 10).cast("double")
    return bits / F.lit(float(1 << 52))
