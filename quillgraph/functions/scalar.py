"""Element-wise functions on columns: text, nulls, arrays, activations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text ---


def upper(c: Col) -> Column:
    return F.upper(_c(c))


def lower(c: Col) -> Column:
    return F.lower(_c(c))


def byte_length(c: Col) -> Column:
    """Length in UTF-8 bytes."""
    return F.octet_length(_c(c))


def strip(c: Col) -> Column:
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def contains(c: Col, s: str) -> Column:
    return _c(c).contains(s)


def startswith(c: Col, s: str) -> Column:
    return _c(c).startswith(s)


def endswith(c: Col, s: str) -> Column:
    return _c(c).endswith(s)


def replace(c: Col, old: str, new: str) -> Column:
    return F.replace(_c(c), F.lit(old), F.lit(new))


def split_first(c: Col, by: str) -> Column:
    """What stands before the first ``by``; the whole text where there is none."""
    return F.split_part(_c(c), F.lit(by), F.lit(1))


def slice_text(c: Col, start: int, length: int) -> Column:
    """``length`` characters from position ``start`` (from 0)."""
    return F.substring(_c(c), start + 1, length)


def pad(c: Col, width: int, side: str = "left", fill: str = " ") -> Column:
    """Filled up to ``width`` characters; texts that are longer stay."""
    x = _c(c)
    n = F.char_length(x)
    if side == "left":
        out = F.lpad(x, width, fill)
    elif side == "right":
        out = F.rpad(x, width, fill)
    else:
        out = F.rpad(F.lpad(x, F.lit(width) - F.ceil((F.lit(width) - n) / 2).cast("int"), F.lit(fill)), width, fill)
    return F.when(n >= width, x).otherwise(out)


# --- arrays ---


def array_mean(c: Col) -> Column:
    x = F.array_compact(_c(c))
    return F.when(F.size(x) > 0, array_sum(x) / F.size(x))


def array_sum(c: Col) -> Column:
    return F.aggregate(F.array_compact(_c(c)), F.lit(0.0), lambda a, x: a + x)


def array_std(c: Col) -> Column:
    """Sample deviation; null below two values."""
    x = F.array_compact(_c(c))
    mean = array_mean(x)
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    return F.when(F.size(x) > 1, F.sqrt(squares / (F.size(x) - 1)))


def slice_array(c: Col, start: int, length: int) -> Column:
    return F.slice(_c(c), start + 1, length)


def dot(a: Col, b: Col) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Col, b: Col) -> Column:
    """Cosine of two vectors; null where one has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


# --- numbers ---


def clip(c: Col, low: float, high: float) -> Column:
    return F.when(_c(c).isNotNull(), F.greatest(F.least(_c(c), F.lit(high)), F.lit(low)))


def recip(c: Col, eps: float = 1e-9) -> Column:
    """Reciprocal that never divides by less than ``eps``; zero counts as positive."""
    x = _c(c)
    return F.when(x < 0, -1.0).otherwise(1.0) / F.greatest(F.abs(x), F.lit(eps))


def safe_div(a: Col, b: Col) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(_c(b) == 0, 0.0).otherwise(F.try_divide(_c(a), _c(b)))


def compare(a: Column, op: str, b: Column) -> Column:
    """1.0 where the comparison holds, else 0.0."""
    tests = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}
    return F.coalesce(tests[op], F.lit(False)).cast("double")


def where(cond: Column, a: Column, b: Column) -> Column:
    return F.when(cond != 0, a).otherwise(b)


# --- activations and their derivatives ---


def relu(c: Col) -> Column:
    return F.greatest(_c(c), F.lit(0.0))


def leaky_relu(c: Col, slope: float = 0.01) -> Column:
    return F.when(_c(c) > 0, _c(c)).otherwise(_c(c) * slope)


def elu(c: Col, alpha: float = 1.0) -> Column:
    return F.when(_c(c) > 0, _c(c)).otherwise(F.expm1(_c(c)) * alpha)


def sigmoid(c: Col) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(c)))


def tanh(c: Col) -> Column:
    return F.tanh(_c(c))


def swish(c: Col) -> Column:
    return _c(c) * sigmoid(c)


def gelu(c: Col) -> Column:
    """The usual tanh approximation."""
    x = _c(c)
    return 0.5 * x * (1.0 + F.tanh(F.lit((2 / 3.141592653589793) ** 0.5) * (x + 0.044715 * x * x * x)))


def relu_derivative(c: Col) -> Column:
    return F.when(_c(c) > 0, 1.0).otherwise(0.0)


def sigmoid_derivative(c: Col) -> Column:
    return sigmoid(c) * (1.0 - sigmoid(c))


def tanh_derivative(c: Col) -> Column:
    return 1.0 - F.tanh(_c(c)) * F.tanh(_c(c))


def swish_derivative(c: Col) -> Column:
    return swish(c) + sigmoid(c) * (1.0 - swish(c))


def gelu_derivative(c: Col) -> Column:
    x, k = _c(c), (2 / 3.141592653589793) ** 0.5
    t = F.tanh(F.lit(k) * (x + 0.044715 * x * x * x))
    return 0.5 * (1.0 + t) + 0.5 * x * (1.0 - t * t) * (k * (1.0 + 3 * 0.044715 * x * x))
