"""Edit-aware token counts.

A document is kept as leaves of consecutive pre-tokens under a segment tree of sums (characters and tokens). The trees
are a table: the text, and the two arrays of sums in heap order (node i has the children 2i and 2i + 1; the leaves are
the last half). Building them reads every text once; each later table of edits only reads trees. An edit
re-reads the leaves that it touches and leaves behind them until a pre-token ends where a leaf ended before; all other
leaves keep their counts, and only the sums on their way to the root are renewed. This is exact because a pre-token
depends on no text before it, and on the text behind it only up to the second character and the first that is no
white space (an apostrophe may begin a contraction, a run of white space gives its last character away). So that
much unedited text is kept between an edit and the first leaf that is read again, and is read along behind the last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import merge
from itertools import accumulate, repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.batches import rows, table, values
from corpusloom.llm.keys import text_of
from corpusloom.llm.tokens import encoder
from corpusloom.plans.storage import Stash

LEAF = 32
#: What is redacted before counting again: mail addresses and long numbers.
REDACTIONS = ((r"[\w.+-]+@[\w-]+\.[\w.-]*\w", "<EMAIL>"), (r"\+?\d(?:[ .()-]?\d){6,}", "<PHONE>"))


def _settles(text: str) -> bool:
    """Whether text behind a pre-token fixes its end, whatever follows."""
    return len(text) > 1 and not text.isspace()


class TokenTree:
    """Counts the tokens of a text and keeps the count through edits."""

    def __init__(self, text: str, find: Callable[[str], list[str]], count: Callable[[str], int], leaf: int = LEAF):
        tokens = find(text)
        leaves = ["".join(tokens[i : i + leaf]) for i in range(0, len(tokens), leaf)] or [""]
        sums = [sum(map(count, tokens[i : i + leaf])) for i in range(0, len(tokens), leaf)] or [0]
        size = 1 << (len(leaves) - 1).bit_length()
        pad = [0] * (size - len(leaves))
        self._hold(leaves, [0] * size + [len(x) for x in leaves] + pad, [0] * size + sums + pad, find, count)
        for i in range(size - 1, 0, -1):
            self._sum(i)

    def _hold(self, leaves: list[str], chars: list[int], tokens: list[int], find: Callable[[str], list[str]], count: Callable[[str], int]) -> None:
        self.leaves, self.chars, self.tokens, self.size = leaves, chars, tokens, len(chars) // 2
        self.find, self.count, self.reread = find, count, 0

    @classmethod
    def stored(cls, text: str, chars: list[int], tokens: list[int], find: Callable[[str], list[str]], count: Callable[[str], int]) -> TokenTree:
        """From a row of the table of trees; nothing is encoded."""
        tree = cls.__new__(cls)
        half = len(chars) // 2
        ends = list(accumulate(chars[half:]))
        if len(tokens) != len(chars) or ends[-1] != len(text):
            raise ValueError("the tree is not one of this text")
        tree._hold([text[a:b] for a, b in zip([0, *ends], ends, strict=False)], list(chars), list(tokens), find, count)
        return tree

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def __len__(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at ``position`` (the last one at the end), and where it starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if position >= start + self.chars[i] and (self.chars[i + 1] or position > start + self.chars[i]):
                start += self.chars[i]
                i += 1
        return min(i - self.size, len(self.leaves) - 1), start

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        i = leaf + self.size
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self._sum(i)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of characters start..end; returns the tokens of the whole text."""
        if not 0 <= start <= end <= len(self):
            raise ValueError("the edit lies outside the text")
        first, at = self._leaf_at(start)
        before = self.leaves[first][: start - at]
        while first and not _settles(before):
            first -= 1
            at -= len(self.leaves[first])
            before = self.leaves[first] + before
        last, length = first, len(self.leaves[first])
        while at + length < end:
            last += 1
            length += len(self.leaves[last])
        joined = "".join(self.leaves[first : last + 1])
        joined = joined[: start - at] + new + joined[end - at :]
        while True:
            following, context = last + 1, ""
            while following < len(self.leaves) and not _settles(context):
                context += self.leaves[following]
                following += 1
            found, length = [], 0
            for token in self.find(joined + context):
                if length >= len(joined):
                    break
                found.append(token)
                length += len(token)
            if length == len(joined):
                break
            joined, last = joined + context, following - 1
        self.reread += len(found)
        self._set(first, joined, sum(map(self.count, found)))
        for i in range(first + 1, last + 1):
            if self.leaves[i]:
                self._set(i, "", 0)
        return self.total


def redactions(text: str, patterns: tuple[tuple[regex.Pattern, str], ...]) -> list[tuple[int, int, str]]:
    """Edits in ascending order that do not overlap; an earlier pattern has precedence."""
    taken: list[tuple[int, int, str]] = []
    for pattern, new in patterns:
        found, at = [], 0  # both lists ascend, so one step through them finds what overlaps
        for m in pattern.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if m.end() > m.start() and (at == len(taken) or taken[at][0] >= m.end()):
                found.append((m.start(), m.end(), new))
        taken = list(merge(taken, found))
    return taken


def _compiled(patterns: tuple[tuple[str, str], ...]) -> tuple[tuple[regex.Pattern, str], ...]:
    return tuple((regex.compile(p), new) for p, new in patterns)


_TREE_NAMES, _TREE_KINDS = ("row", "doc_id", "text", "chars", "tokens"), (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
_TREE = "row long, doc_id long, text string, chars array<int>, tokens array<int>"
EDIT = "array<struct<start:int,stop:int,new:string>>"


def _sent(rows_of: Iterator[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...], most: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows_of:
        held.append(row)
        if len(held) >= most:
            yield table(held, names, kinds)
            held = []
    yield table(held, names, kinds)


def build_trees(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """A written table of trees, one for each row of ``docs``: row (a number of its own), doc_id, text, chars, tokens.

    tokens[1] is the document's count. Null texts are kept as empty ones; repeated rows have a tree each; a null id
    stays null; an empty table gives an empty one. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, True, True)

        def trees(b: pa.RecordBatch) -> Iterator[tuple]:
            for row, doc, text in rows(b, 0, 1, 2):
                tree = TokenTree(text, own.find, own.token_count, leaf)
                yield row, doc, text, tree.chars, tree.tokens

        for b in batches:
            yield from _sent(trees(b), _TREE_NAMES, _TREE_KINDS)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return Stash(texts.mapInArrow(run, _TREE), "trees").df


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """``trees`` with a column ``edits``: those of a table of edits (row, start, stop, new), in ascending order. Trees
    without edits have null. An edit is a row of numbers and a short text; edits of rows that no tree has are ignored."""
    grouped = edits.select("row", F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("new").alias("new")).alias("e"))
    grouped = grouped.groupBy("row").agg(F.array_sort(F.collect_list("e")).alias("edits"))
    return trees.join(grouped, "row", "left")


def apply_edits(trees: DataFrame, tokenizer: str, patterns: tuple[tuple[str, str], ...] | None = None, only_counts: bool = False) -> DataFrame:
    """The trees after their edits, with n_tokens and n_tokens_edited (before and after), n_edits and reread.

    The edits are those of the column ``edits`` (see ``with_edits``; positions in characters of the text as it is,
    ascending, not overlapping: others raise ValueError), or with ``patterns`` what they match in the text. ``reread``
    is how many pre-tokens were encoded again. A tree without edits comes back as it was and nothing is encoded for it.
    ``only_counts`` leaves text, chars and tokens out.
    """
    names = (*(("row", "doc_id") if only_counts else _TREE_NAMES), "n_tokens", "n_edits", "n_tokens_edited", "reread")
    kinds = (*(_TREE_KINDS[:2] if only_counts else _TREE_KINDS), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    schema = ("row long, doc_id long" if only_counts else _TREE) + ", n_tokens long, n_edits int, n_tokens_edited long, reread long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = _compiled(patterns or ())
        own = encoder(tokenizer, True, True)

        def edited(b: pa.RecordBatch) -> Iterator[tuple]:
            listed = values(b.column("edits")) if patterns is None else repeat(())
            for (row, doc, text, chars, tokens), own_edits in zip(rows(b, *_TREE_NAMES), listed, strict=False):
                edits = [(e["start"], e["stop"], e["new"] or "") for e in own_edits or ()] if patterns is None else redactions(text, compiled)
                before, reread = tokens[1], 0
                if edits:
                    tree, shift, end = TokenTree.stored(text, chars, tokens, own.find, own.token_count), 0, 0
                    for start, stop, new in edits:
                        if not end <= start <= stop <= len(text):
                            raise ValueError(f"row {row}: the edits overlap or lie outside the text")
                        tree.replace(start + shift, stop + shift, new)
                        shift, end = shift + len(new) - (stop - start), stop
                    text, chars, tokens, reread = tree.text(), tree.chars, tree.tokens, tree.reread
                counts = (before, len(edits), tokens[1], reread)
                yield (row, doc, *counts) if only_counts else (row, doc, text, chars, tokens, *counts)

        for b in batches:
            yield from _sent(edited(b), names, kinds)

    return trees.select(*_TREE_NAMES, *([] if patterns is not None else [F.col("edits").cast(EDIT).alias("edits")])).mapInArrow(run, schema)


def edited_counts(docs: DataFrame, tokenizer: str, patterns: tuple[tuple[str, str], ...] = REDACTIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_edits, n_tokens_edited, reread.

    Builds and writes the trees, then applies all redactions edit by edit: n_tokens counts the text as it is and
    n_tokens_edited the edited one. Null texts count as empty. Repeated rows each keep their row, a null id stays null,
    an empty table gives an empty result. Other columns are not looked at. Control strings are ordinary text.
    """
    done = apply_edits(build_trees(docs, tokenizer, id_col, text_col), tokenizer, patterns, only_counts=True)
    return done.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "reread")
