"""Text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends and the space that is stripped from lines.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
STRIP = "^[\\s\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x1c-\\x1f\\x85\\p{Z}]+$"


def clean_text(s: Column) -> Column:
    """No-break spaces to blanks, zero-width marks away, runs of blanks to one, lines stripped, empty lines away."""
    s = F.regexp_replace(F.translate(s, "\u00a0", " "), "[\u200b\u200e\u200f]+", "")
    lines = F.split(F.regexp_replace(s, "[ \\t\u00a0]+", " "), LINE_ENDS)
    lines = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, STRIP, "")), lambda x: x != "")
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def normalize(s: Column) -> Column:
    """Runs of white space to one blank, trimmed, lower case; null to empty."""
    return F.coalesce(F.lower(F.trim(F.regexp_replace(s, "(?U)\\s+", " "))), F.lit(""))


def split_safe(s: Column, most: int = 1000) -> Column:
    """Sentences, those of more than ``most`` characters cut up."""
    parts = F.filter(F.transform(F.split(s, "(?<=[.?!])\\s+"), lambda x: F.regexp_replace(x, STRIP, "")), lambda x: x != "")
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most).cast("int")), lambda i: F.substr(x, i * most + 1, F.lit(most)))
    return F.flatten(F.transform(parts, cut))


def gold_pattern(gold: Column) -> Column:
    """The pattern of a gold passage: lower case, blanks match any white space, no word character at either end."""
    escaped = F.regexp_replace(F.lower(gold), r"([\\.\[\]{}()*+\-?^$|&~#])", r"\\$1")
    return F.concat(F.lit(r"(?sU)(?<!\w)"), F.regexp_replace(escaped, " ", r"\\s+"), F.lit(r"(?!\w)"))


def holds(text: Column, gold: Column) -> Column:
    """Whether ``gold`` stands in ``text`` between word boundaries."""
    return F.regexp_like(F.lower(text), gold_pattern(gold))


def index_name(experiment: Column, model: Column) -> Column:
    return F.replace(F.concat_ws("_", experiment, model), F.lit("/"), F.lit("_"))


def strategy(name: Column) -> Column:
    low, out = F.lower(name), F.lit("Other")
    for word, label in (("sentence", "Sentence"), ("fixed", "Fixed"), ("recursive", "Recursive"), ("semantic", "Semantic")):
        out = F.when(F.contains(low, F.lit(word)), label).otherwise(out)
    return out


def params(name: Column) -> dict[str, Column]:
    """Size and overlap of fixed and recursive names (if both stand there), threshold of semantic ones."""
    kind, ints = strategy(name), F.regexp_extract_all(name, F.lit(r"(\d+)"), 1)
    sized = kind.isin("Fixed", "Recursive") & (F.size(ints) >= 2)
    threshold = F.nullif(F.regexp_extract(name, r"t(\d?\.?\d+)", 1), F.lit(""))
    return {
        "param_size": F.when(sized, F.get(ints, F.lit(0)).cast("double")),
        "param_overlap": F.when(sized, F.get(ints, F.lit(1)).cast("double")),
        "param_threshold": F.when(kind == "Semantic", threshold.cast("double")),
    }


#: Upper bounds of chunk sizes and their labels; right-closed.
SIZE_BINS = ((200, "XS"), (400, "S"), (600, "M"), (800, "L"), (1000, "XL"), (2000, "XXL"), (10000, "Huge"))


def size_bin(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for bound, label in reversed(SIZE_BINS):
        out = F.when(x <= bound, label).otherwise(out)
    return F.when(x > 0, out)


def numeric(x: Column) -> Column:
    """Numbers; what is none, and NaN, to null."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v), v)


def pair_of(answer: Column) -> tuple[Column, Column]:
    """Category and difficulty of 'Category | Difficulty'; both Unknown if there are not two parts."""
    parts = F.split(answer, "\\|")
    good = F.size(parts) == 2
    return tuple(F.when(good, F.trim(F.get(parts, F.lit(i)))).otherwise("Unknown") for i in (0, 1))


def parse_reply(reply: Column) -> Column:
    """struct<question, answer, gold_snippets> of a JSON reply, bare or fenced; what is no JSON gets a sentinel."""
    bare = F.regexp_replace(F.regexp_replace(reply, "```(?:json)?", ""), STRIP, "")
    got = F.from_json(bare, "question string, answer string, gold_snippets array<string>")
    broken = F.struct(F.lit("Error parsing generation").alias("question"), F.lit("Error").alias("answer"), F.array().cast("array<string>").alias("gold_snippets"))
    return F.when(F.get_json_object(bare, "$").isNotNull() & F.startswith(bare, F.lit("{")), got).otherwise(broken)


def valid_reply(r: Column) -> Column:
    """Replies that are kept: neither impossible nor broken, and with snippets."""
    q, a = F.coalesce(r["question"], F.lit("")), F.coalesce(r["answer"], F.lit(""))
    return (q != "IMPOSSIBLE") & (a != "IMPOSSIBLE") & (q != "Error parsing generation") & (F.coalesce(F.size(r["gold_snippets"]), F.lit(0)) > 0)


def folder_parts(folder: Column, meta_model: Column | None = None) -> dict[str, Column]:
    """Model, difficulty and configuration of a result folder's name."""
    model, rest = (F.regexp_extract(folder, "^(.*?)_(0[12]_.*)$", i) for i in (1, 2))
    difficulty, config = F.lit("All"), rest
    for d in ("Easy", "Hard", "Moderate"):
        ends = F.endswith(rest, F.lit("_" + d))
        difficulty = F.when(ends, d).otherwise(difficulty)
        config = F.when(ends, F.substr(rest, F.lit(1), F.length(rest) - len(d) - 1)).otherwise(config)
    found = rest != ""
    fallback = F.coalesce(meta_model if meta_model is not None else F.lit(None).cast("string"), F.lit("unknown"))
    return {"embedding_model": F.when(found, model).otherwise(fallback), "config_difficulty": F.when(found, difficulty).otherwise("All"), "experiment_config": F.when(found, config).otherwise(folder)}


def dataset_type(config: Column) -> Column:
    low = F.lower(config)
    return F.when(F.contains(low, F.lit("gold")), "Gold").when(F.contains(low, F.lit("silver")), "Silver").otherwise("Unknown")


def relevant_file(path: Column) -> Column:
    return ~F.contains(path, F.lit("/archive/")) & (F.endswith(path, F.lit("metadata.json")) | F.endswith(path, F.lit("_detailed_results.csv")))


def renamed_blob(path: Column) -> Column:
    path = F.regexp_replace(path, "^(chunks/.*)/metadata\\.json$", "$1/chunks_metadata.json")
    return F.regexp_replace(path, "^(indices/.*)/[^/]*metadata\\.json$", "$1/index_metadata.json")


def category_prompt(question: Column) -> Column:
    return F.concat(F.lit("Name the category and the difficulty (Easy, Moderate, Hard) of this question, as: Category | Difficulty\nQuestion: "), question)


def multihop_prompt(first: Column, second: Column) -> Column:
    return F.concat(F.lit("Write a question that only both passages together answer, as JSON with question, answer, gold_snippets; IMPOSSIBLE if there is none.\nA: "), first, F.lit("\nB: "), second)
