"""Labels, prompts and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours of the first instances, red, green, blue.
INSTANCE_COLOURS = ((230, 25, 75), (60, 180, 75), (255, 225, 25), (0, 130, 200), (245, 130, 48), (145, 30, 180), (70, 240, 240), (240, 50, 230), (210, 245, 60), (250, 190, 190))


def normalised_prompt(prompt: Column) -> Column:
    """Lower case, trimmed, ended by one full stop."""
    low = F.lower(F.trim(prompt))
    return F.when(low.endswith("."), low).otherwise(F.concat(low, F.lit(".")))


def prompt_phrases(prompt: Column) -> Column:
    """The phrases between full stops, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(prompt, r"\."), lambda x: F.trim(x)), lambda x: x != "")


def contains_chinese(text: Column) -> Column:
    return text.rlike("[一-鿿]")


def label_for_file(text: Column, name: Column, sem_id: Column) -> Column:
    """Text, else the name of the class, else its number; no commas, lower case."""
    best = F.coalesce(F.nullif(F.trim(text), F.lit("")), name, sem_id.cast("string"))
    return F.lower(F.regexp_replace(best, ",", " "))


def instance_colour(instance: Column) -> Column:
    """Ten fixed colours, then three linear sequences modulo 256."""
    fixed = F.array(*[F.array(*[F.lit(c) for c in rgb]) for rgb in INSTANCE_COLOURS])
    rest = F.array(*[F.pmod(instance * a + b, F.lit(256)).cast("int") for a, b in ((73, 97), (151, 53), (199, 211))])
    return F.when((instance >= 0) & (instance < len(INSTANCE_COLOURS)), F.get(fixed, instance.cast("int"))).otherwise(rest)


def label_hue(label: Column) -> Column:
    """A hue in [0, 1) from the label's MD5, so that equal labels have equal colours everywhere."""
    return F.conv(F.substring(F.md5(label), 1, 4), 16, 10).cast("double") / 65536.0


def hex_colour(text: Column) -> Column:
    """#rrggbb as an array of three numbers; null where it is none."""
    part = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("int")
    return F.when(text.rlike("^#[0-9a-fA-F]{6}$"), F.array(part(2), part(4), part(6)))


def padded_text(text: Column, n: int = 128) -> Column:
    """Characters of one byte, cut or padded with spaces to a fixed number."""
    return F.rpad(F.regexp_replace(text, "[^\u0000-ÿ]", ""), n, " ")
