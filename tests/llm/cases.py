"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LICENCES = [
    "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0.\nmit license MIT License  mit-license", "Licensed under CC BY-NC 4.0.",
    "a general public license and an apache license here\nthe mit licensed", "released under the license",
]


def texts() -> list[str | None]:
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    long = " ".join(f"word{i % 977}x{i}" for i in range(6000))
    repeated = "\n".join([line] * 6)
    return [
        None, "", " ", "\n\n \t", "a", "é ü ñ 日本語 text", line, line.upper(), line + ".", long, long + " tail", repeated,
        "<|endoftext|> it's <|endoftext|>don't  stop \n\n now", "### $$$ *** " * 30, "x" * 5000, "a b\x0bc\x1cd\xa0e　f",
        "one two one two one two one two one two one two one two one two one two one two one two", *LICENCES,
        *[f"document {i} speaks of thing{i} and thing{i + 1} with number {i * i} in {i % 5} lines\nsecond line {i}" for i in range(40)],
        *[" ".join(f"w{(i * 7 + j) % 31}" for j in range(40 + i)) for i in range(20)],
    ]


def rows() -> list[tuple]:
    out = [(3 * i - 5, t, [None, "en", "fr"][i % 3], [None, "src0", "src0", "src1"][i % 4], len(t or "")) for i, t in enumerate(texts())]
    return out + [out[5], out[5], (10_000, out[9][1], "en", "src0", 1), (out[6][0], "another text under a used id", None, None, None)]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def nobody(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
