"""Grids: coordinates, neighbourhoods and maps from columns to inputs, as expressions and small tables."""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.sdr import Shape


def coordinates(index: Column, dims: tuple[int, ...]) -> list[Column]:
    """The row-major coordinates of an index."""
    return [(F.floor(index / F.lit(s)) % F.lit(d)).cast("int") for s, d in zip(Shape(dims).strides, dims, strict=True)]


def index(coords: list[Column], dims: tuple[int, ...]) -> Column:
    return Shape(dims).flat(*coords)


def _wrapped(span: Column, d: int) -> Column:
    return F.array_distinct(F.transform(span, lambda x: F.pmod(x, F.lit(d))))


def _crossed(cells: Column, span: Column, stride: int) -> Column:
    """Every cell plus every place of the span times the stride."""
    return F.flatten(F.transform(cells, lambda base: F.transform(span, lambda x: base + x * F.lit(stride))))


def neighborhood(centre: Column, dims: tuple[int, ...], radius: int, *, wrap: bool = False, with_centre: bool = True) -> Column:
    """array<int> of the cells within radius in every dimension, ascending and distinct."""
    cells = F.array(F.lit(0))
    for c, d, s in zip(coordinates(centre, dims), dims, Shape(dims).strides, strict=True):
        if wrap:
            span = _wrapped(F.sequence(c - radius, c + radius), d)
        else:
            span = F.sequence(F.greatest(c - radius, F.lit(0)), F.least(c + radius, F.lit(d - 1)))
        cells = _crossed(cells, span, s)
    cells = F.array_sort(cells)
    return cells if with_centre else F.array_remove(cells, centre)


def map_column_to_input(column: Column, columns: tuple[int, ...], inputs: tuple[int, ...]) -> Column:
    """The input at the same relative place as a column."""
    places = [F.least(F.floor((c + 0.5) * (i / k)), F.lit(i - 1)).cast("int") for c, k, i in zip(coordinates(column, columns), columns, inputs, strict=True)]
    return index(places, inputs)


def potential_pool(column: Column, columns: tuple[int, ...], inputs: tuple[int, ...], radius: int, wrap: bool = False) -> Column:
    return neighborhood(map_column_to_input(column, columns, inputs), inputs, radius, wrap=wrap)


def receptive_field_radius(sizes: Column, num_dims: int) -> Column:
    """An aggregate: half the side, less one, of a cube of average size."""
    return F.greatest(F.lit(0.0), (F.pow(F.avg(sizes), F.lit(1.0 / num_dims)) - 1) / 2)


def neighbor_table(spark: SparkSession, dims: tuple[int, ...], radius: int, *, wrap: bool = False, with_centre: bool = False) -> DataFrame:
    """(cell, nbr) of a grid: for joins."""
    cells = spark.range(prod(dims)).select(F.col("id").cast("int").alias("cell"))
    return cells.select("cell", F.explode(neighborhood(F.col("cell"), dims, radius, wrap=wrap, with_centre=with_centre)).alias("nbr"))


def num_elements(dims: tuple[int, ...]) -> int:
    return reduce(lambda a, b: a * b, dims, 1)
