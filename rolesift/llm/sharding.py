"""Sharding by a hierarchical weighted hash tree: regions, racks, shards.

A row descends. Each region draws ``-ln(u) / weight`` for the row, with u from a digest of the row's
key and the region's name and the summed weight of its shards, and the least draw wins. The racks of
that region draw next, then the shards of that rack. So a row makes one draw for each child of the
nodes it passes, not one for each shard, and every shard gets rows in proportion to its weight.

A subtree whose weight stays has the same draws as before, so rows move only between subtrees whose
weights change: more weight in a subtree takes rows into it and moves none out of it; below it the
same holds for its own children. A new shard in a region of its own takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.llm.shared import staged

#: Hex digits that make a draw: 48 bits, exact in a double.
_DIGITS = 12


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """Shards in order, ``per_rack`` in a rack and ``racks`` in a region; the next shard starts or
    fills the last rack."""
    return [Shard(s, s // (per_rack * racks), s // per_rack % racks) for s in range(shards)]


def unit_draw(key: Column, name: str) -> Column:
    """A number in (0, 1) from the md5 of key and name."""
    digest = F.substring(F.md5(F.concat(key, F.lit(":" + name))), 1, _DIGITS)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def _tree(shards: list[Shard]) -> dict[int, dict[int, list[Shard]]]:
    tree: dict[int, dict[int, list[Shard]]] = {}
    for shard in sorted(shards, key=lambda s: (s.region, s.rack, s.number)):
        if shard.weight > 0:
            tree.setdefault(shard.region, {}).setdefault(shard.rack, []).append(shard)
    return tree


def _weight(racks: dict[int, list[Shard]]) -> float:
    return float(sum(s.weight for rack in racks.values() for s in rack))


def _draw(name: str, weight: float) -> Column:
    return -F.log(unit_draw(F.col("_key"), name)) / F.lit(weight)


def _winner(draws: dict[int, Column]) -> Column:
    """The child with the least draw, the smallest of its numbers on a tie; an only child draws nothing."""
    options = [F.struct(draw.alias("draw"), F.lit(child).alias("child")) for child, draw in draws.items()]
    return F.lit(next(iter(draws))) if len(options) == 1 else F.least(*options)["child"]


def _chosen(chosen: Column, below: dict[int, Column]) -> Column:
    """What the chosen child says; the other children are not evaluated."""
    (_, first), *others = below.items()
    return reduce(lambda rest, o: F.when(chosen == o[0], o[1]).otherwise(rest), others, first)


def _below(keyed: DataFrame, region: str, tree: dict[int, dict[int, list[Shard]]], out: str) -> DataFrame:
    """Add ``out``, the shard that a row descends to from the region that it has chosen."""
    racks = {
        g: _winner({r: _draw(f"rack-{g}-{r}", _weight({r: rack})) for r, rack in of_region.items()})
        for g, of_region in tree.items()
    }
    racked = keyed.select("*", _chosen(F.col(region), racks).alias("_rack"))
    shards = {
        g: _chosen(
            F.col("_rack"),
            {r: _winner({s.number: _draw(f"shard-{s.number}", float(s.weight)) for s in rack}) for r, rack in of_region.items()},
        )
        for g, of_region in tree.items()
    }
    return racked.select(*keyed.columns, _chosen(F.col(region), shards).cast("int").alias(out))


def _keyed(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("_key", F.coalesce(key.cast("string"), F.lit("")))


def place(df: DataFrame, key: Column, shards: list[Shard], out: str) -> DataFrame:
    """Add ``out``, the shard that each row's key descends to. A null key counts as an empty one."""
    tree = _tree(shards)
    if not tree:
        raise ValueError("no shard has any weight")
    regions = _winner({g: _draw(f"region-{g}", _weight(racks)) for g, racks in tree.items()})
    chosen = _keyed(df, key).select("*", regions.alias("_region"))
    return _below(chosen, "_region", tree, out).select(*df.columns, out)


def place_grown(
    df: DataFrame, key: Column, shards: list[Shard], grown: list[Shard], out: str, grown_out: str
) -> DataFrame:
    """Add ``out`` and ``grown_out``, the shards of each row before and after regions are added.

    The result is that of two calls of ``place``, but every draw is made once. The regions of
    ``shards`` must be in ``grown`` as they are (else ValueError): only then do rows move into the
    new regions and nowhere else.
    """
    tree, larger = _tree(shards), _tree(grown)
    if not tree or any(larger.get(g) != racks for g, racks in tree.items()):
        raise ValueError("a grown tree has the regions of the tree as they are, and further ones")
    added = {g: racks for g, racks in larger.items() if g not in tree}
    draws = {g: _draw(f"region-{g}", _weight(racks)) for g, racks in larger.items()}
    drawn = _keyed(df, key).select("*", *[d.alias(f"_g{g}") for g, d in draws.items()])
    chosen = drawn.select(
        *df.columns, "_key",
        _winner({g: F.col(f"_g{g}") for g in tree}).alias("_region"),
        _winner({g: F.col(f"_g{g}") for g in larger}).alias("_grown_region"),
    )
    placed = _below(chosen, "_region", tree, out)
    if not added:
        return placed.select(*df.columns, out, F.col(out).alias(grown_out))
    moved = F.col("_grown_region").isin(list(added))
    placed = _below(placed, "_grown_region", added, "_new")
    after = F.when(moved, F.col("_new")).otherwise(F.col(out))
    return placed.select(*df.columns, out, after.alias(grown_out))


def with_slots(df: DataFrame, shard: str, order: list[str], slice_rows: int = 100_000) -> DataFrame:
    """Add ``slot``: gapless from 0 within each shard, in the order of a draw and then ``order``.

    A shard is cut into slices of its draws of about ``slice_rows`` rows, so no task sorts a whole
    shard; each slice starts at the number of rows before it, which is a sum over slices.
    ``df`` is read twice, so it should be a written table. It needs the column ``draw``, 0 to 2**32.
    """
    slices = max(1, -(-df.count() // slice_rows))
    cut = df.withColumn("_slice", F.floor(F.col("draw") * slices / float(2**32)))
    counts = cut.groupBy(shard, "_slice").agg(F.count("*").alias("_n"))
    before = (
        f"sum(_n) OVER (PARTITION BY {shard} ORDER BY _slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    starts = counts.select(shard, "_slice", F.coalesce(F.expr(before), F.lit(0)).alias("_start"))
    keys = ", ".join(["draw", *order])
    nth = f"row_number() OVER (PARTITION BY {shard}, _slice ORDER BY {keys}) - 1"
    ranked = cut.withColumn("_nth", F.expr(nth))
    return ranked.join(starts, [shard, "_slice"]).select(
        *df.columns, (F.col("_start") + F.col("_nth")).cast("long").alias("slot")
    )


def shard_documents(
    docs: DataFrame,
    shards: list[Shard],
    grown: list[Shard],
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_rows: int = 100_000,
) -> DataFrame:
    """Put every row into one of ``shards``, and say where it would be with ``grown``.

    The law is ``key``: the id and the shards decide, nothing else, and rows move only into what is
    new. So ``grown`` must keep the regions of ``shards`` as they are and add further ones (else
    ValueError). Returns one row per input row:
    ``<id_col>``, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot (gapless from 0
    within the shard), grown_shard.

    * A null text has 8 bytes and the checksum of an empty text.
    * A null id counts as an empty key, so all such rows share a shard.
    * Rows with one id share a shard, as the law demands, and still get slots of their own; equal
      rows get theirs in any order.
    * Other columns are not read. An empty table gives an empty result.
    * A text is only measured and summed up, whole, in the scan; however long, it is never shuffled.

    Slots of a shard are dealt in slices (see ``with_slots``); only rows equal in id and text share
    a slice whatever their number, at 40 bytes each, which Spark sorts with spilling.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = place_grown(slim, F.col("_id"), shards, grown, "shard", "grown_shard")
    # rows that repeat an id are spread as well, as long as their texts differ
    row_key = F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("")), "size", "text_crc32", F.lit("slot"))
    head = F.substring(F.md5(row_key), 1, 8)
    placed = staged(placed.withColumn("draw", F.conv(head, 16, 10).cast("long")), "shards")
    slotted = with_slots(placed, "shard", ["_id", "size", "text_crc32"], slice_rows)
    return slotted.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
