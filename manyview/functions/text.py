"""Numbers and camera data out of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A number: a sign or none, then digits with a fraction or none, or a fraction alone, then an exponent or none. A point
# needs digits after it, so `5.` is 5 and `1.e5` is 1 and 5.
SIGN = "[-+]?"
DIGITS = "[0-9]+"
FRACTION = rf"\.{DIGITS}"
EXPONENT = f"[eE]{SIGN}{DIGITS}"
NUMBER = f"{SIGN}(?:{DIGITS}(?:{FRACTION})?|{FRACTION})(?:{EXPONENT})?"


def floats(text: Column) -> Column:
    """All numbers in a text, as an array of doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda s: s.cast("double"))


def _json_numbers(body: Column, path: str) -> Column:
    """The numbers at a JSON path, flattened; NULL if the path isn't there."""
    at = F.get_json_object(body, path)
    return F.when(at.isNotNull(), floats(at))


def intrinsics(body: Column) -> Column:
    """The nine numbers of K, row by row, of a text with nine numbers or more or of JSON: `K`, `intrinsic`, `intrinsics.K`, `fx, fy, cx, cy`,
    or any of these under `camera`. NULL if there are none."""
    is_json = F.ltrim(body).startswith("{")
    cases = []
    for root in ("$", "$.camera"):
        cases += [_json_numbers(body, f"{root}.K"), _json_numbers(body, f"{root}.intrinsic"), _json_numbers(body, f"{root}.intrinsics.K")]
        four = [F.get_json_object(body, f"{root}.{k}").cast("double") for k in ("fx", "fy", "cx", "cy")]
        whole = F.array(four[0], F.lit(0.0), four[2], F.lit(0.0), four[1], four[3], F.lit(0.0), F.lit(0.0), F.lit(1.0))
        cases.append(F.when(four[0].isNotNull() & four[1].isNotNull() & four[2].isNotNull() & four[3].isNotNull(), whole))
    plain = floats(body)
    return F.when(is_json, F.coalesce(*cases)).when(F.size(plain) >= 9, F.slice(plain, 1, 9))


def distortion(body: Column) -> Column:
    """The numbers after the ninth, or those at `dist`; NULL if there are none."""
    plain = floats(body)
    return F.when(F.ltrim(body).startswith("{"), F.coalesce(_json_numbers(body, "$.dist"), _json_numbers(body, "$.camera.dist"))).when(F.size(plain) > 9, F.slice(plain, F.lit(10), F.size(plain)))


def projection(body: Column) -> Column:
    """The twelve numbers of P, row by row, of a text with twelve or more or of JSON `P` or `projection`, also under `camera`."""
    plain = floats(body)
    found = F.coalesce(*[_json_numbers(body, p) for p in ("$.P", "$.projection", "$.camera.P", "$.camera.projection")])
    return F.when(F.ltrim(body).startswith("{"), found).when(F.size(plain) >= 12, F.slice(plain, 1, 12))


def valid_intrinsics(k: Column) -> Column:
    """Nine finite numbers, the last one 1, positive focal lengths."""
    sane = F.forall(k, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(k) == 9) & sane & (F.abs(F.get(k, F.lit(8)) - 1) <= 1e-6) & (F.get(k, F.lit(0)) > 0) & (F.get(k, F.lit(4)) > 0), F.lit(False))


def stem(path: Column) -> Column:
    """The file name without folder and last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
