"""Timestamps in mixed formats, precisions and zones, normalised to UTC.

Each text is read in every valid way (``functions/timeparse.py``): every order of a numeric date, every unit of a plain
number, both instants of a local time that occurs twice. Which reading holds is decided per source by
expectation-maximisation over a mixture of forms: a reading's likelihood is the source's share of its form times the
density of the delay between that instant and the arrival of the row, times a small factor where it is against the rule
of arrival (of two instants of one local time the latest not after the arrival). Plain numbers may also be no time at
all, a component of its own. Posteriors give new shares until they settle, and then choose. The source's declared date
order, where given, is a prior of the shares (a Dirichlet of ``DECLARED`` counts). A choice below ``confidence`` is
marked ``ambiguous`` and gets no instant.

An exact check follows: where an order is declared, a purely numeric date takes it, whatever the posterior (column
``overridden``; no row of the test tables).

Times with an offset in the text, in the ISO form, are read by the JVM; the kernel reads the others.

Scale: rows shrink to (source, signature) counts before the shuffle, where a signature is the set of readings with
their delays in bins; a source has a bounded number of them, so the EM of a source with a third of all rows is
as small as any other. Only rows with several readings are joined back; AQE splits a hot source there.

Defined results: null, empty and senseless texts have status ``none``; a local time without zone whose source has no
zone likewise; a local time that occurs twice and has no arrival time is ``ambiguous``, and so is a plain number that
lies far from its arrival in every unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.functions.timeparse import interpretations, zone
from pathloom.functions.times import micros
from pathloom.operators.blocks import reliable

NONSENSE = "nonsense"
FORMS = ("epoch_s", "epoch_ms", "epoch_us", NONSENSE, "ymd4", "named", "dmy", "mdy", "ymd")
DECLARED = 50.0  # Dirichlet count of a declared date order
# Upper edges of the delay bins in hours, from "long before it was sent" on, and the log density of each. Delays are
# mostly minutes, sometimes weeks; readings in the wrong order are weeks to months off, in the wrong unit years.
_YEAR = 24 * 366.0
_EDGES = np.array([-_YEAR, -1.0, 0.0, 1.0, 6.0, 24.0, 24 * 7.0, 24 * 21.0, 24 * 60.0, _YEAR])
# then of an unknown arrival: within the plausible era, and outside of it
_LOG_DENSITY = np.log(np.array([1e-9, 1e-7, 1e-4, 0.8, 5e-2, 1e-2, 3e-3, 1e-3, 1e-5, 1e-6, 1e-9, 1.0, 1e-6]))
_UNKNOWN, _OTHER_ERA = len(_EDGES) + 1, len(_EDGES) + 2
_ERA = (631_152_000_000_000, 4_102_444_800_000_000)  # 1990 to 2100
_LOG_AGAINST = math.log(1e-6)  # against the rule of arrival
_LOG_NONSENSE = math.log(1e-8)
_ISO = r"^\s*\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}([.,]\d{1,6})?\s*(Z|z|[+-]\d{2}:?\d{2})\s*$"


def _bin(us: int, received: int | None) -> int:
    if received is None:
        return _UNKNOWN if _ERA[0] <= us < _ERA[1] else _OTHER_ERA
    return int(np.searchsorted(_EDGES, (received - us) / 3.6e9))


def _signature(found: list[tuple[str, int, bool]], received: int | None) -> str:
    return "|".join(f"{form}:{_bin(us, received)}{'x' if against else ''}" for form, us, against in found)


_NONE = -(1 << 62)  # stands for a missing time in integer columns
_ISO_SIGNATURES = np.array([f"ymd4:{b}" for b in range(len(_LOG_DENSITY))], dtype=object)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for d in batches:
        done, got = d["done"].to_numpy(), d["got"].to_numpy()
        era = np.where((done >= _ERA[0]) & (done < _ERA[1]), _UNKNOWN, _OTHER_ERA)
        bins = np.where(got == _NONE, era, np.searchsorted(_EDGES, (got - done) / 3.6e9))
        sig, us = _ISO_SIGNATURES[bins], done[:, None].tolist()
        text, tz = d["txt"].to_numpy(object), d["tz"].to_numpy(object)
        for i in np.flatnonzero(done == _NONE):
            at = None if got[i] == _NONE else int(got[i])
            found = interpretations(text[i], zone(tz[i]) if tz[i] is not None else None, at)
            sig[i] = _signature(found, at)
            us[i] = [u for _, u, _ in found]
        yield pd.DataFrame({"id": d["id"], "src": d["src"], "declared": d["declared"], "sig": sig, "us": us})


def _em(d: pd.DataFrame) -> pd.DataFrame:
    """For each signature of one source: the reading of the largest posterior (-1: no time at all) and, among those of
    the declared order, the largest again."""
    declared = d["declared"].iloc[0]
    alpha = np.array([1.0 + (DECLARED if f == declared else 0.0) for f in FORMS])
    forms, logs = [], []
    for s in d["sig"]:
        parts = [p.split(":") for p in s.split("|")]
        f = [FORMS.index(name) for name, _ in parts]
        ll = [_LOG_DENSITY[int(b.rstrip("x"))] + (_LOG_AGAINST if b.endswith("x") else 0.0) for _, b in parts]
        if parts[0][0].startswith("epoch"):
            f, ll = [*f, FORMS.index(NONSENSE)], [*ll, _LOG_NONSENSE]
        forms.append(np.array(f))
        logs.append(np.array(ll))
    count = d["n"].to_numpy(float)
    pi = alpha / alpha.sum()

    def posterior(f: np.ndarray, ll: np.ndarray) -> np.ndarray:
        w = np.log(pi[f]) + ll
        w = np.exp(w - w.max())
        return w / w.sum()

    for _ in range(200):
        new = alpha.copy()
        for f, ll, c in zip(forms, logs, count):
            np.add.at(new, f, c * posterior(f, ll))
        new /= new.sum()
        settled = np.abs(new - pi).max() < 1e-10
        pi = new
        if settled:
            break
    out = []
    for f, ll in zip(forms, logs):
        w = posterior(f, ll)
        best = int(w.argmax())
        own = np.flatnonzero(f == FORMS.index(declared)) if declared in FORMS else np.empty(0, int)
        bound = int(own[w[own].argmax()]) if len(own) else -1
        within = np.exp(ll[own] - ll[own].max()) if len(own) else np.ones(1)
        out.append((-1 if FORMS[f[best]] == NONSENSE else best, float(w[best]), bound, float(within.max() / within.sum())))
    pick, post, bound, sure = zip(*out)
    return pd.DataFrame({"src": d["src"], "declared": d["declared"], "sig": d["sig"], "pick": pick, "posterior": post, "own": bound, "own_posterior": sure})


def normalise_timestamps(
    df: DataFrame,
    sources: DataFrame,
    row_id: str = "fix_id",
    text: str = "DateTime",
    source: str = "station_id",
    received: str = "received_at",
    time_zone: str = "time_zone",
    date_order: str = "date_order",
    confidence: float = 0.9,
) -> DataFrame:
    """``fix_id, utc_us, status (resolved|ambiguous|none), form, posterior, overridden`` for every row.

    ``sources``: one row per source with its zone and declared order (both may be null).
    """
    about = sources.groupBy(F.col(source).cast("string").alias("src")).agg(F.max(time_zone).alias("tz"), F.max(date_order).alias("declared"))
    txt = F.col(text).cast("string")
    iso = F.regexp_replace(F.regexp_replace(F.translate(F.upper(F.trim(txt)), "T,", " ."), "Z$", "+00:00"), r"\s*([+-]\d{2}):?(\d{2})$", "$1:$2")
    done = F.when(txt.rlike(_ISO), F.unix_micros(iso.try_cast("timestamp")))
    rows = df.select(F.col(row_id).cast("string").alias("id"), F.col(source).cast("string").alias("src"), txt.alias("txt"), F.coalesce(micros(received), F.lit(_NONE)).alias("got"), F.coalesce(done, F.lit(_NONE)).alias("done"))
    joined = rows.join(about, "src", "left").select("id", "src", "declared", "tz", "txt", "got", "done")
    parsed = reliable(joined.mapInPandas(_parse, "id string, src string, declared string, sig string, us array<long>"))
    counts = parsed.where(F.col("sig") != "").groupBy("src", "declared", "sig").agg(F.count("*").alias("n"))
    choices = counts.groupBy("src", "declared").applyInPandas(_em, "src string, declared string, sig string, pick int, posterior double, own int, own_posterior double")
    several = F.instr("sig", "|") > 0
    c = choices.where(several)
    p = parsed.where(several)
    met = p.join(c.withColumnRenamed("src", "s2").withColumnRenamed("sig", "g2").drop("declared"), F.col("src").eqNullSafe(F.col("s2")) & (F.col("sig") == F.col("g2"))).drop("s2", "g2")
    forms = F.transform(F.split("sig", "\\|"), lambda x: F.split(x, ":")[0])
    # a single reading has posterior 1 whatever the shares
    one = {"pick": F.lit(0), "posterior": F.when(F.col("sig") != "", 1.0), "own": F.when(forms[0] == F.col("declared"), 0).otherwise(-1), "own_posterior": F.lit(1.0)}
    every = met.unionByName(parsed.where(~several).withColumns(one)).withColumn("forms", forms)
    numeric = F.array_contains(F.array(*(F.lit(f) for f in ("dmy", "mdy", "ymd"))), F.col("forms")[0])
    # the exact check: a numeric date follows the declared order, and has no instant if it is invalid in it. For
    # a declared "ymd" a year at the end contradicts the declaration, so the posterior decides
    bound = numeric & F.coalesce(F.col("declared").isin("dmy", "mdy", "ymd"), F.lit(False)) & ~((F.col("declared") == "ymd") & (F.col("own") < 0))
    out = every.withColumns({"bound": F.coalesce(bound, F.lit(False)), "sense": F.col("sig") != ""})
    out = out.withColumns({"at": F.when(F.col("bound"), F.col("own")).otherwise(F.col("pick")), "sure": F.when(F.col("bound"), F.col("own_posterior")).otherwise(F.col("posterior")) >= confidence})
    there = F.col("sense") & (F.col("at") >= 0)
    status = F.when(there & F.col("sure"), "resolved").when(there | (F.col("sense") & ~F.col("bound")), "ambiguous").otherwise("none")
    return out.select(
        F.col("id").cast(df.schema[row_id].dataType).alias(row_id), F.when(there & F.col("sure"), F.get("us", F.col("at"))).alias("utc_us"), status.alias("status"),
        F.when(there, F.get("forms", F.col("at"))).alias("form"), "posterior", (F.col("sense") & F.col("bound") & (F.col("own") != F.col("pick"))).alias("overridden"),
    )
