"""Generation-parameter normalisation (F3-F5) and left truncation.

Parameters travel as ``map<string,string>`` (values in JSON-like text: ``1024``,
``true``, ``0.01``; a null value is an explicitly present ``None``).  Every
function is a map/array expression; an explicit null counts as present.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.constants import (
    API_PARAM_DEFAULTS,
    BATCH_PARAM_DEFAULTS,
    LOCAL_PARAM_DEFAULTS,
    LOCAL_SAMPLING_DEFAULTS,
)

_ABSENT = object()
_FALSY = ("0", "0.0", "false", "False", "", "None")


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def value_text(v: Any) -> str | None:
    """How a Python parameter value is written in the map."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


def params_map(d: Mapping[str, Any]) -> Column:
    """A literal parameter map."""
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), (v if isinstance(v, Column) else F.lit(value_text(v))).cast("string")]
    return F.create_map(*kv) if kv else F.create_map().cast("map<string,string>")


def has_key(m: Column, key: str) -> Column:
    return F.array_contains(F.map_keys(m), F.lit(key))


def get(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def truthy(v: Column) -> Column:
    """Python truthiness of a parameter value."""
    return F.coalesce(v.isNotNull() & ~v.isin(*_FALSY), F.lit(False))


def _rename(m: Column, old: str, new: str) -> Column:
    return F.transform_keys(m, lambda k, v: F.when(k == F.lit(old), F.lit(new)).otherwise(k))


def _drop(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def gen_params_api(params: Column | str) -> Column:
    """Hosted API (F3): when ``max_new_tokens`` is truthy, rename it to
    ``max_completion_tokens`` and drop ``do_sample`` and ``num_beams``."""
    m = _col(params)
    renamed = _rename(_drop(m, "do_sample", "num_beams", "max_completion_tokens"), "max_new_tokens", "max_completion_tokens")
    return F.when(truthy(get(m, "max_new_tokens")), renamed).otherwise(m)


def gen_params_batch(params: Column | str, strict: bool = False) -> Column:
    """Batch engine (F4): when ``max_new_tokens`` is truthy, rename it to
    ``max_tokens``, drop ``do_sample`` and move ``num_beams`` to ``n``.  A
    missing ``num_beams`` raised in the harness; leniently ``n`` is left out."""
    m = _col(params)
    base = _rename(_drop(m, "do_sample", "num_beams", "max_tokens"), "max_new_tokens", "max_tokens")
    with_n = F.map_concat(_drop(base, "n"), F.create_map(F.lit("n"), get(m, "num_beams")))
    missing = F.raise_error(F.lit("num_beams is required")).cast("map<string,string>") if strict else base
    moved = F.when(has_key(m, "num_beams"), with_n).otherwise(missing)
    return F.when(truthy(get(m, "max_new_tokens")), moved).otherwise(m)


def fill_defaults(params: Column | str, defaults: Column) -> Column:
    """Add default entries only for absent keys (``dict.setdefault``)."""
    m = _col(params)
    return F.map_concat(m, F.map_filter(defaults, lambda k, v: ~F.array_contains(F.map_keys(m), k)))


def local_defaults(params: Column | str) -> Column:
    """Local-model defaults: sampling keys default only when sampling is on."""
    m = _col(params)
    sampling = F.when(has_key(m, "do_sample"), truthy(get(m, "do_sample"))).otherwise(
        F.lit(bool(LOCAL_PARAM_DEFAULTS["do_sample"])))
    d = dict(LOCAL_PARAM_DEFAULTS)
    for k, v in LOCAL_SAMPLING_DEFAULTS.items():
        d[k] = F.when(sampling, F.lit(value_text(v)))
    return fill_defaults(m, params_map(d))


def gen_params_defaults(params: Column | str, backend: Column | str, model: Column | None = None) -> Column:
    """Per-backend normalisation then defaults (F5): ``api`` -> F3 + the model
    and API defaults, ``vllm`` -> F4 + batch defaults, otherwise local
    defaults."""
    m, b = _col(params), _col(backend)
    return (F.when(b == "api", fill_defaults(gen_params_api(m), params_map({"model": model, **API_PARAM_DEFAULTS})))
            .when(b == "vllm", fill_defaults(gen_params_batch(m), params_map(BATCH_PARAM_DEFAULTS)))
            .otherwise(local_defaults(m)))


def params_text(params: Column | str) -> Column:
    """Stable text form: sorted ``key=value`` pairs joined by ``;``."""
    m = _col(params)
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ";")


def left_truncate(tokens: Column | str, n: Column | str | int) -> Column:
    """Keep the last ``n`` tokens; ``n`` null or 0 leaves the array alone.

    ``slice(t, -n, n)`` would return ``[]`` when ``n > size``, so the start is
    clamped at 1.
    """
    t = _col(tokens)
    nn = F.lit(n) if isinstance(n, int) else _col(n)
    return F.when(nn.isNull() | (nn == 0), t).otherwise(F.slice(t, F.greatest(F.lit(1), F.size(t) - nn + 1), nn))


def normalized_params(params: Mapping[str, Any], backend: str, model: str | None = None) -> dict[str, Any]:
    """One run's parameters for its backend (F3-F5) as typed values: numbers
    and booleans reach the client as such.  Configuration, so plain Python;
    the column forms above are the same rules for rows."""
    out = dict(params)
    long_name = {"api": "max_completion_tokens", "vllm": "max_tokens"}.get(backend)
    if long_name and out.get("max_new_tokens"):
        out[long_name] = out.pop("max_new_tokens")
        out.pop("do_sample", None)
        beams = out.pop("num_beams", None) if "num_beams" in out else _ABSENT
        if backend == "vllm" and beams is not _ABSENT:
            out["n"] = beams
    if backend == "api":
        defaults = {"model": model, **API_PARAM_DEFAULTS}
    elif backend == "vllm":
        defaults = dict(BATCH_PARAM_DEFAULTS)
    else:
        sampling = out.get("do_sample", LOCAL_PARAM_DEFAULTS["do_sample"])
        defaults = {**LOCAL_PARAM_DEFAULTS, **{k: v if sampling else None for k, v in LOCAL_SAMPLING_DEFAULTS.items()}}
    return {**defaults, **out}
