"""Images and masks as flat arrays, row by row: seeded cropping, flipping and turning as one gather of places.

A place array says, for every cell of the result, which element of the input it is. It is computed once a row and gathers image and mask
alike. Random choices come from a hash of seed, key and purpose, so a repeated task, or another cluster, makes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .probs import bind


def seeded(key: Column, seed: int, purpose: str) -> Column:
    """A whole number from 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), key.cast("string"))), 1, 8), 16, 10).cast("long")


def below(key: Column, seed: int, purpose: str, n: int) -> Column:
    """A whole number from 0 to n - 1."""
    return (seeded(key, seed, purpose) % n).cast("int")


def places(width: int, height: int, across: int, y: Column, x: Column, h_flip: Column, v_flip: Column, turns: Column) -> Column:
    """Source places of a window of ``height`` by ``across`` cells at row y and column x of an image ``width`` wide: mirrored as the flags say, then
    turned counter-clockwise by ``turns`` quarters, which swaps the sides if odd."""
    odd, back = turns % 2 == 1, turns >= 2
    wide = F.when(odd, height).otherwise(across)

    def source(k: Column) -> Column:
        r, c = F.floor(k / wide).cast("int"), (k % wide).cast("int")
        # one quarter: (r, c) comes from (c, across - 1 - r); two: from (height - 1 - r, across - 1 - c); three: from (height - 1 - c, r)
        row = F.when(odd, F.when(back, height - 1 - c).otherwise(c)).otherwise(F.when(back, height - 1 - r).otherwise(r))
        col = F.when(odd, F.when(back, r).otherwise(across - 1 - r)).otherwise(F.when(back, across - 1 - c).otherwise(c))
        row = F.when(v_flip, height - 1 - row).otherwise(row)
        col = F.when(h_flip, across - 1 - col).otherwise(col)
        return (y + row) * width + x + col

    return F.transform(F.sequence(F.lit(0), F.lit(height * across - 1)), source)


def turned_places(height: int, width: int, degrees: Column) -> Column:
    """Source places after turning an image about its middle counter-clockwise, by the nearest cell; null for cells from outside."""

    def of(ends: Column) -> Column:
        def source(k: Column) -> Column:
            r, c = F.floor(k / width) - height // 2, k % width - width // 2
            col = F.floor(ends["cos"] * c - ends["sin"] * r + width // 2 + 0.5).cast("int")
            row = F.floor(ends["sin"] * c + ends["cos"] * r + height // 2 + 0.5).cast("int")
            return F.when((row >= 0) & (row < height) & (col >= 0) & (col < width), row * width + col)

        return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), source)

    a = F.radians(degrees)
    return bind(F.struct(F.cos(a).alias("cos"), F.sin(a).alias("sin")), of)


def gathered(a: Column, where: Column, outside: Column | None = None) -> Column:
    """The elements of ``a`` at ``where``; ``outside`` stands where the place is null."""
    return F.when(a.isNotNull(), bind(a, lambda v: F.transform(where, lambda p: F.when(p.isNull(), outside).otherwise(F.element_at(v, p + 1)))))


def brightened(a: Column, factor: Column, most: float = 255.0) -> Column:
    """Values times a factor, up to ``most``."""
    return F.when(a.isNotNull(), bind(factor, lambda f: F.transform(a, lambda x: F.least(x * f, F.lit(most)))))


def augment(
    rows: DataFrame, key: str, image: str, mask: str | None, shape: tuple[int, int], window: tuple[int, int], seed: int = 0, h_flip: bool = True, v_flip: bool = True, quarters: bool = False, brightness: float = 0.0, rotation: float = 0.0, most: float = 255.0
) -> DataFrame:
    """(…, image, mask, height, width): a seeded window of each image and its mask, mirrored, brightened and turned.

    ``quarters`` turns by whole quarters and swaps the sides of what is turned by an odd number of them; ``rotation`` turns by up to so many degrees, with 0 for
    cells from outside. A window larger than the image, or an image or mask of another size than ``shape``, is an error; null ones stay null.
    """
    (h, w), (ch, cw) = shape, window
    if ch > h or cw > w:
        raise ValueError(f"a window of {ch} x {cw} exceeds images of {h} x {w}")
    k = F.col(key)
    y, x = below(k, seed, "y", h - ch + 1), below(k, seed, "x", w - cw + 1)
    flag = lambda on, what: (below(k, seed, what, 2) == 1) if on else F.lit(False)
    turns = below(k, seed, "quarters", 4) if quarters else F.lit(0)
    made = rows.withColumn("_at", F.struct(y.alias("y"), x.alias("x"), flag(h_flip, "h").alias("h"), flag(v_flip, "v").alias("v"), turns.alias("t")))
    made = made.withColumn("_places", bind(F.col("_at"), lambda a: places(w, ch, cw, a["y"], a["x"], a["h"], a["v"], a["t"])))
    factor = 1.0 + brightness * (2.0 * seeded(k, seed, "brightness") / 4294967295.0 - 1.0)
    angle = rotation * (2.0 * seeded(k, seed, "rotation") / 4294967295.0 - 1.0)
    sized = lambda c: F.when(F.size(c) == h * w, F.col(c)).when(F.col(c).isNotNull(), F.raise_error(F.lit(f"{c} has to have {h} x {w} cells")))
    out = {}
    for c in [image] + ([mask] if mask else []):
        v = gathered(sized(c), F.col("_places"))
        if c == image and brightness:
            v = brightened(v, factor, most)
        if rotation:
            zero = F.lit(0).cast(rows.schema[c].dataType.elementType)
            v = gathered(v, turned_places(ch, cw, angle), zero)
        out[c] = v
    odd = F.col("_at")["t"] % 2 == 1
    out |= {"height": F.when(odd, cw).otherwise(ch), "width": F.when(odd, ch).otherwise(cw)}
    if quarters and rotation:
        raise ValueError("either quarters or a rotation")
    return made.withColumns(out).drop("_at", "_places")
