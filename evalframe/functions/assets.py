"""Image-asset expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalframe.constants import DATA_URL_PREFIX, URL_SCHEMES


# The scheme of a path in a store, with its slashes; like URL schemes, only in lower case.
_SCHEME = r"^[a-z][a-z0-9+.-]*://"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def is_url(path: Column | str) -> Column:
    """Starts with ``http://`` or ``https://`` (case-sensitive)."""
    p = _col(path)
    expr = None
    for scheme in URL_SCHEMES:
        e = p.startswith(scheme)
        expr = e if expr is None else expr | e
    return expr


def normalize_path(path: Column | str) -> Column:
    """``pathlib``'s lexical normalisation: repeated slashes collapse, ``.``
    segments and a trailing slash are dropped (``..`` is kept).  The
    ``scheme://`` of a store's path is kept as it is."""
    whole = _col(path)
    scheme = F.regexp_extract(whole, _SCHEME, 0)
    x = F.regexp_replace(F.substring(whole, F.length(scheme) + 1, F.length(whole)), "/+", "/")
    x = F.regexp_replace(x, r"^(\./)+", "")
    x = F.regexp_replace(x, r"/\.(?=/|$)", "")
    x = F.regexp_replace(x, r"(?<=.)/$", "")
    return F.when((x == F.lit("")) & (scheme == F.lit("")), F.lit(".")).otherwise(F.concat(scheme, x))


def resolve_path(base: Column | str, path: Column | str) -> Column:
    """``Path(base) / path`` (E2): an absolute path or one with a scheme
    (``s3://``, ``hdfs://``) wins, an empty base leaves the path alone, and the
    result is normalised like ``pathlib``."""
    b = _col(base)
    p = _col(path)
    joined = (F.when(p.startswith("/") | p.rlike(_SCHEME), p)
              .when(b.isNull() | (b == F.lit("")), p)
              .otherwise(F.concat(b, F.lit("/"), p)))
    return normalize_path(joined)


def data_url(content: Column | str) -> Column:
    """Bytes -> ``data:image/jpeg;base64,...``.

    Needs ``spark.sql.chunkBase64String.enabled=false`` (set by
    ``session.apply_required_conf``); otherwise Spark inserts CRLF every 76
    characters.
    """
    return F.concat(F.lit(DATA_URL_PREFIX), F.base64(_col(content)))
