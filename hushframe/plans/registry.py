"""All operators by name: of frames (chainable on a PrivateFrame), aggregates, mechanisms and private statistics."""

from __future__ import annotations

from functools import partial

from hushframe.operators import aggregates as A
from hushframe.operators import mechanisms as M
from hushframe.operators import preprocess as P
from hushframe.operators import structure as S

TRANSFORMS = ("abs", "add", "subtract", "multiply", "divide", "modulo", "power", "log", "negative", "negate", "and", "or", "equal", "greater_than", "less_than", "row_max", "row_min")


def _transform(op: str, frame, out: str, left, right=None, **more):
    return P.transform(frame, out, op, left, right, **more)


FRAMES = {
    "to_dataframe": S.to_dataframe, "index": S.index, "column_bind": S.column_bind, "union": A.union, "partition": S.partition_by, "partition_even": S.partition_even,
    "flatten": S.flatten_parts, "map": S.map_parts, "filter": S.filter_rows, "clamp": P.clamp, "impute": P.impute, "resize": P.resize, "digitize": P.digitize, "bin": P.bin_value,
    "subset": P.subset, "cast": P.cast, "to_bool": P.to_bool, "to_float": P.to_float, "to_int": P.to_int, "to_string": P.to_string, "theil_sen": A.theil_sen,
}
FRAMES |= {("logical_" + op if op in ("and", "or") else op): partial(_transform, op) for op in TRANSFORMS}
AGGREGATES = {
    "count": A.count, "sum": A.sum_, "mean": A.mean, "variance": A.variance, "covariance": A.covariance, "raw_moment": A.raw_moment, "quantile": A.quantile,
    "minimum": A.minimum, "median": A.median, "maximum": A.maximum, "histogram": A.histogram, "theil_sen_slope": A.theil_sen_slope,
}
MECHANISMS = {
    "laplace_mechanism": M.laplace_mechanism, "gaussian_mechanism": M.gaussian_mechanism, "simple_geometric_mechanism": M.simple_geometric_mechanism,
    "snapping_mechanism": M.snapping_mechanism, "exponential_mechanism": M.exponential_mechanism, "dp_gumbel_median": M.dp_gumbel_median,
}
STATISTICS = {
    "dp_count": M.dp_count, "dp_sum": M.dp_sum, "dp_mean": M.dp_mean, "dp_variance": M.dp_variance, "dp_covariance": M.dp_covariance, "dp_raw_moment": M.dp_raw_moment,
    "dp_quantile": M.dp_quantile, "dp_median": M.dp_median, "dp_minimum": M.dp_minimum, "dp_maximum": M.dp_maximum, "dp_histogram": M.dp_histogram,
    "dp_linear_regression": M.dp_linear_regression, "noisy_stats_regression": M.noisy_stats_regression,
}
OPERATORS = FRAMES | AGGREGATES | MECHANISMS | STATISTICS
