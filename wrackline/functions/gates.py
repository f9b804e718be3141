"""Gates and small measures over results of training and serving, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fail(test: Column, why: Column, value: Column) -> Column:
    """value, or an error where the test holds; the value itself carries the check, so that pruning can't lose it."""
    return F.when(test, F.raise_error(why).cast("double")).otherwise(value)


def gpu_hours(started: Column, now: Column, gpus: Column | int) -> Column:
    """Hours since the start on all GPUs; a clock that runs backwards counts as none. Times in seconds."""
    return F.greatest(now - started, F.lit(0.0)) / 3600 * (F.lit(gpus) if isinstance(gpus, int) else gpus)


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def improved(base: Column, adapter: Column, tolerance: float = 0.0) -> Column:
    """Whether the adapter's perplexity is no worse than the base's, but for the tolerance."""
    return adapter - base <= tolerance


def checked_improvement(base: Column, adapter: Column, tolerance: float = 0.0) -> Column:
    """adapter - base; worse than the tolerance is an error."""
    return _fail(~improved(base, adapter, tolerance), F.lit("perplexity did not improve"), adapter - base)


def finite(loss: Column) -> Column:
    return loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) < F.lit(float("inf")))


def plausible(loss: Column, most: float = 12.0) -> Column:
    """A finite loss under `most`."""
    return finite(loss) & (loss < most)


def activation(target_off: Column, target_on: Column, other_off: Column, other_on: Column, least: float = 1e-3) -> Column:
    """`inactive` if the adapter hardly moves the target's log-probability, `suspect` if it moves the control's far more, else `active`."""
    moved, other = F.abs(target_on - target_off), F.abs(other_on - other_off)
    return F.when(moved < least, "inactive").when(other > 2 * moved + 1e-3, "suspect").otherwise("active")


def fitting_duration(seconds: Column, most: float, slack: float = 0.5) -> Column:
    return seconds <= most + slack


def checked_duration(seconds: Column, most: float, slack: float = 0.5) -> Column:
    """The duration; one beyond the limit is an error."""
    return _fail(~fitting_duration(seconds, most, slack), F.format_string("%.1f s of audio, the limit is %s s", seconds, F.lit(str(most))), seconds)


def convolved_length(frames: Column, block: int = 100, out: int = 13) -> Column:
    """Length after three convolutions of stride 2 over blocks of frames: `out` for each whole block, the rest halved upwards three times."""
    rest, whole = frames % block, F.floor(frames / block) * out
    halved = rest
    for _ in range(3):
        halved = F.floor((halved - 1) / 2) + 1
    return F.when(rest == 0, whole).otherwise(halved + whole).cast("bigint")


def text_config(raw: Column) -> Column:
    """struct<rope_theta, rope_scaling, num_experts> (JSON of each) of a text model's configuration in either layout.

    The flat key holds; else the one nested under rope_parameters, or the older name of the number of experts.
    """
    get = lambda path: F.to_json(F.try_variant_get(F.try_parse_json(raw), path, "variant"))
    nested = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), "$.rope_parameters", "variant")).startswith("OBJECT")
    scaling = F.coalesce(get("$.rope_scaling"), F.when(nested, F.lit('{"type":"default"}')))
    return F.struct(
        F.coalesce(get("$.rope_theta"), get("$.rope_parameters.rope_theta")).alias("rope_theta"), scaling.alias("rope_scaling"), F.coalesce(get("$.num_experts"), get("$.num_local_experts")).alias("num_experts")
    )


def ignored(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a path fits one of the globs: `*` and `?` within the whole path, a glob that ends in `/` for all below it."""
    out = F.lit(False)
    for g in globs:
        pattern = "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" for c in g + ("*" if g.endswith("/") else ""))
        out = out | path.rlike("(?s)\\A" + pattern + "\\z")
    return out
