"""Dialogue and fine-tuning data: trees, prompts, labels and token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.normalize import CHAT_PUNCT, replace_chars
from corpusloom.plans.ordering import running_sums
from corpusloom.plans.storage import Stash

# Prompt templates and role prefixes.
WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response: "
)
WITHOUT_INPUT = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n{instruction}\n\n### Response: "
ROLE_PREFIX = {"prompter": "### ユーザー: ", "assistant": "### アシスタント: "}
IGNORED = -100


def first_child_paths(messages: DataFrame, id_col: str = "message_id", parent: str = "parent_id", order: str = "pos", root: str = "nan") -> DataFrame:
    """root, depth, message: from each root always to the first child (ties go to the least id), to any depth.

    One join per level; levels are written. A path longer than there are messages is a cycle and raises ValueError.
    """
    child = messages.where(F.col(parent) != root).groupBy(parent).agg(F.min(F.struct(order, id_col))[id_col].alias("child"))
    child = Stash(child.toDF("parent", "child"), "children").df
    level = messages.where(F.col(parent) == root).select(F.col(id_col).alias("root"), F.lit(0).alias("depth"), F.col(id_col).alias("message"))
    out, depth, links = level, 0, child.count()
    while True:
        level = Stash(level.join(child, level["message"] == child["parent"]).select("root", (F.col("depth") + 1).alias("depth"), F.col("child").alias("message")), "level").df
        if level.isEmpty():
            return out
        depth += 1
        if depth > links:
            raise ValueError("the messages form a cycle")
        out = out.union(level)


def complete_dialogues(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", last: str = "assistant", longest: int | None = None) -> DataFrame:
    """conv, last_role, n_chars of conversations that end with ``last`` and are no longer than ``longest``."""
    g = turns.groupBy(conv).agg(F.max_by(role, turn).alias("last_role"), F.sum(F.length(text)).alias("n_chars"))
    g = g.where(F.col("last_role") == last)
    return g if longest is None else g.where(F.col("n_chars") <= longest)


def chat_prompts(turns: DataFrame, prefixes: dict[str, str] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", punct: bool = True) -> DataFrame:
    """conv, prompt: turns in order with their role's prefix, joined by line feeds."""
    prefix = F.lit("")
    for r, p in (ROLE_PREFIX if prefixes is None else prefixes).items():
        prefix = F.when(F.col(role) == r, F.lit(p)).otherwise(prefix)
    body = replace_chars(F.col(text), CHAT_PUNCT) if punct else F.col(text)
    listed = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.concat(prefix, F.coalesce(body, F.lit(""))).alias("m"))))
    return turns.groupBy(conv).agg(F.array_join(F.transform(listed, lambda x: x["m"]), "\n").alias("prompt"))


def instruction_prompt(instruction: Column, extra: Column) -> Column:
    fill = lambda template, **kw: _fill(template, kw)
    return F.when(F.coalesce(extra, F.lit("")) != "", fill(WITH_INPUT, instruction=instruction, input=extra)).otherwise(fill(WITHOUT_INPUT, instruction=instruction))


def _fill(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    parts, rest = [], template
    while rest:
        name = min((k for k in values if "{" + k + "}" in rest), key=lambda k: rest.index("{" + k + "}"), default=None)
        if name is None:
            parts.append(F.lit(rest))
            break
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), F.coalesce(values[name], F.lit(""))]
    return F.concat(*parts) if parts else out


def flatten_instances(df: DataFrame) -> DataFrame:
    """instruction, input, output from rows (instruction, instances, reformulations): a row per instance and one per
    reformulation, with the reformulation's own instruction."""
    a = df.select("instruction", F.inline("instances"))
    b = df.select(F.inline("reformulations"))
    return a.select("instruction", "input", "output").unionByName(b.select("instruction", "input", "output"))


def over_length(turns: DataFrame, limit: int, conv: str = "conv_id", text: str = "text") -> DataFrame:
    return turns.groupBy(conv).agg(F.sum(F.length(text)).alias("n")).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("n") > limit).alias("n_over"))


def token_blocks(tokens: DataFrame, block: int, group: str = "batch", order: str = "doc_id", col: str = "tokens") -> DataFrame:
    """group, block_no, ids: the group's tokens in order cut into blocks; a remainder goes. Positions come from running
    sums over ranges of the order, so a group may be the whole corpus; what meets in one row is a block."""
    at = running_sums(tokens.withColumn("__n", F.size(col)), [order], "__n", "__at", group)
    each = at.select(group, "__at", F.posexplode(col).alias("p", "id")).withColumn("i", F.col("__at") + F.col("p"))
    blocks = each.groupBy(group, F.floor(F.col("i") / block).alias("block_no")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("ids"))
    return blocks.where(F.size("ids") == block)


def masked_labels(source: Column, target: Column, longest: int, pad: int) -> Column:
    """struct(input_ids, labels, attention_mask) of a source and a target, cut to ``longest`` and padded."""
    cut = lambda a: F.slice(a, F.lit(1), F.lit(longest))
    padded = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), F.lit(longest) - F.size(a)))
    ids = padded(cut(F.concat(source, target)), pad)
    labels = padded(cut(F.concat(F.transform(source, lambda _: F.lit(IGNORED)), target)), IGNORED)
    return F.struct(ids.alias("input_ids"), labels.alias("labels"), F.transform(ids, lambda x: F.when(x == pad, 0).otherwise(1)).alias("attention_mask"))
