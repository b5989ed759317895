"""Tree patterns over tables of nodes, matched by joins of children with their parents.

A node is a row: its number in its tree in the order of its beginning (``id``), the largest number within it (``last``), its ``parent``, its place among
its kind under the parent (``ord``, ``of`` so many), how many parts it has (``n``), and ``kind``, ``word`` and ``text``.  A pattern is a small tree of conditions, also as rows.  Patterns are
matched from their leaves up, a level of all patterns at a time, so the number of joins follows the height of the patterns and not their number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import work_folder

NODE = "struct<id:int,last:int,parent:int,kind:string,word:string,text:string,ord:int,of:int,n:int,range:struct<start:struct<line:int,col:int>,end:struct<line:int,col:int>>>"
PATTERNS = "rule string, language string, alt int, node int, up int, height int, parts int, kind string, p_word string, p_text string, p_ord int, p_n int"


@dataclass(frozen=True)
class Twig:
    """Conditions on a node and, each by another child, on its children.

    ``word`` and ``text`` are regular expressions for the whole of what they look at; ``ord`` counts from 0, or from -1 backwards.
    """

    kind: str
    word: str | None = None
    text: str | None = None
    ord: int | None = None
    n: int | None = None
    children: tuple["Twig", ...] = field(default=())

    def height(self) -> int:
        return 1 + max((c.height() for c in self.children), default=-1)


def rows_of(rule: str, language: str, alternatives: tuple[Twig, ...]) -> list[tuple]:
    out: list[tuple] = []

    def put(alt: int, t: Twig, up: int | None, k: int) -> int:
        own = k
        out.append((rule, language, alt, own, up, t.height(), len(t.children), t.kind, t.word, t.text, t.ord, t.n))
        for c in t.children:
            k = put(alt, c, own, k + 1)
        return k

    for alt, t in enumerate(alternatives):
        put(alt, t, None, 0)
    return out


def patterns(spark: SparkSession, twigs: dict[tuple[str, str], tuple[Twig, ...]]) -> DataFrame:
    """A row for each node of each pattern: ``(rule, language) → alternatives``."""
    return spark.createDataFrame([r for (rule, lang), alts in twigs.items() for r in rows_of(rule, lang, alts)], PATTERNS)


def conditions(twigs: dict[tuple[str, str], tuple[Twig, ...]]) -> dict[str, list[tuple[str, str | None, int | None]]]:
    """What a front end needs to leave out nodes that are no pattern's: ``(kind, word, n)`` of the patterns' nodes by language."""
    out: dict[str, set] = {}
    for (rule, lang), alts in twigs.items():
        out.setdefault(lang, set()).update((kind, word, n) for *_, kind, word, _, _, n in rows_of(rule, lang, alts))
    return {lang: sorted(found, key=str) for lang, found in out.items()}


def matches(nodes: DataFrame, patterns_: DataFrame, tree: str = "file") -> DataFrame:
    """``(tree, rule, id, range)``: nodes at which a pattern of their language holds, once for each rule.

    ``nodes(tree, language, id, last, parent, kind, word, text, ord, of, n, range)``.  Nodes are first cut down to those that some pattern's node could be, where they lie: the patterns are
    as small as the pack that they are written in, and dealt out by language and kind all nodes would meet in a few tasks.
    """
    whole = lambda c, p: F.col(p).isNull() | F.regexp_like(c, F.concat(F.lit("^(?:"), F.col(p), F.lit(")$")))
    fits = whole("word", "p_word") & whole("text", "p_text") & (F.col("p_n").isNull() | (F.col("n") == F.col("p_n")))
    place = F.col("p_ord").isNull() | (F.col("ord") == F.col("p_ord")) | (F.col("p_ord") == F.col("ord") - F.col("of"))
    sized = nodes.select(tree, "language", "id", "parent", "kind", "word", "text", "ord", "of", "n", "range")
    cand = sized.join(F.broadcast(patterns_), ["language", "kind"]).filter(fits & place).select(tree, "rule", "alt", "node", "up", "height", "parts", "id", "parent", "range")
    folder = f"{work_folder(nodes.sparkSession)}/twigs"  # few rows; each level reads them, and none parses again
    cand.write.parquet(folder)
    cand = nodes.sparkSession.read.schema(cand.schema).parquet(folder)
    found = cand.filter("height = 0").drop("parts")
    top = patterns_.agg(F.max("height").alias("h")).first()["h"] or 0  # a number of the pattern table, not of the data
    for h in range(1, top + 1):
        below = found.select(tree, "rule", "alt", F.col("up").alias("node"), F.col("parent").alias("id"), F.col("node").alias("part")).distinct()
        held = below.groupBy(tree, "rule", "alt", "node", "id").agg(F.count(F.lit(1)).alias("held"))
        risen = cand.filter(F.col("height") == h).join(held, [tree, "rule", "alt", "node", "id"]).filter("held = parts").select(*found.columns)
        found = found.unionByName(risen)
    return found.filter("up IS NULL").groupBy(tree, "rule", "id").agg(F.any_value("range").alias("range"))
