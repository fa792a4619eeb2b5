"""Deterministic provider-shaped payloads, made by Spark from the catalogue: linear formulas in the row index."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import timeframe_seconds
from .registry import registry, slots

# Time of the last row, rows of a slot.
BASE_TS = 1_782_777_600
ROWS = {"timeframe": 600, "snapshot": 10, "heatmap": 180, "event_list": 120}


def base_value() -> Column:
    """50 plus a hundredth of the sum of the name's code points, mod 10,000."""
    codes = F.aggregate(F.transform(F.split("endpoint_name", ""), F.ascii), F.lit(0), lambda a, c: a + c)
    return 50 + (codes % 10_000) / 100


def _fields(**cells: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in cells.items()])


def _text(struct: Column, when: Column) -> Column:
    return F.when(when, F.to_json(struct))


def records(spark: SparkSession, timeframes: list[str] | None = None, providers: list[str] | None = None) -> DataFrame:
    """One row for each record of each slot: (folder, provider, family, subtype, slot, member, i, record as JSON)."""
    cat = registry(spark)
    cat = cat.where(F.col("folder").isin(*providers)) if providers else cat
    s = slots(cat, timeframes).withColumns({"step": timeframe_seconds(F.col("slot")), "base": base_value()})
    kind, folder = F.col("data_type"), F.col("folder")
    one = (folder == "coinglass") & (kind == "snapshot") | (F.col("subtype") == "gamma_exposure")
    count = F.when(F.col("supports_timeframe"), ROWS["timeframe"]).when(one, 1).when(kind == "snapshot", ROWS["snapshot"]).when(kind == "heatmap", ROWS["heatmap"]).otherwise(ROWS["event_list"])
    rows = s.withColumn("n", count).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    i, base, r6, r2 = F.col("i"), F.col("base"), lambda x: F.round(x, 6), lambda x: F.round(x, 2)
    by_time = F.col("supports_timeframe")
    ts = F.when(by_time, BASE_TS - (F.col("n") - 1 - i) * F.col("step")).otherwise(BASE_TS + i * 60).cast("long")
    v = base + i * 0.03
    iso = F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    cg, cq, gn = folder == "coinglass", folder == "cryptoquant", folder == "glassnode"
    candles, alternate = kind == "candlestick", lambda a, b: F.when(i % 2 == 0, a).otherwise(b)
    open_, volume, price, amount = base + i * 0.05, 1000 + i * 1.7, 61_000 + i * 3.5, 5 + i * 0.15
    split = F.col("subtype").isin("options_open_interest", "options_volume", "exchange_reserve", "stablecoin_flows")
    strikes = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: _fields(strike=58_000 + k * 500, gamma_exposure=r2(-1_250_000 + k * 65_000.0)))
    made = [
        _text(_fields(time=ts * 1000, open=r6(open_), high=r6(open_ + 150), low=r6(open_ - 80), close=r6(open_ + 35), volume=r6(volume), volume_usd=r6(volume * open_)), cg & candles),
        _text(_fields(time=ts * 1000, value=r6(v)), cg & by_time),
        _text(_fields(time=ts * 1000, price_level=r2(58_000 + i * 25.0), liquidation_usd=r2(1_000_000 + i * 15_000.0), side=alternate("long", "short")), cg & (kind == "heatmap")),
        _text(_fields(time=ts * 1000, exchange=F.lit("Binance"), symbol=F.lit("BTCUSDT"), side=alternate("bid", "ask"), price=r2(price), amount=r6(amount), notional_usd=r2(price * amount)), cg & (kind == "event_list")),
        _text(_fields(time=ts * 1000, value=r6(base), window=F.col("slot")), cg),
        _text(_fields(datetime=iso, blockheight=856_000 + i, inflow_total=r6(v * 10), outflow_total=r6(v * 11), netflow_total=r6(-v), reserve=r6(2_450_000 + i * 2.0), reserve_usd=r2(150_000_000_000 + i * 100_000.0)), cq & (F.col("family") == "institutional_flows")),
        _text(_fields(datetime=iso, blockheight=856_000 + i, miner_reserve=r6(1_800_000 + i * 0.2), miner_inflow=r6(42.1 + i * 0.01), miner_outflow=r6(75.4 + i * 0.01), mpi=r6(1.27 + i * 0.001), value=r6(v)), cq & (F.col("family") == "on_chain_miners")),
        F.when(cq, F.concat(F.lit('{"datetime":"'), iso, F.lit('","blockheight":'), (856_000 + i).cast("string"), F.lit(',"'), F.col("subtype"), F.lit('":'), r6(v).cast("string"), F.lit(',"value":'), r6(v).cast("string"), F.lit("}"))),
        _text(_fields(t=ts, v=strikes), gn & (F.col("subtype") == "gamma_exposure")),
        _text(_fields(t=ts, v=_fields(total=r6(v), binance=r6(v * 0.35), coinbase=r6(v * 0.3), okx=r6(v * 0.35))), gn & by_time & split),
        _text(_fields(t=ts, v=r6(F.when(by_time, v).otherwise(base + i * 0.05))), gn),
        _text(_fields(timestamp=ts, value=r6(base + i * 0.01)), F.lit(True)),
    ]
    return rows.select("folder", "provider", "family", "subtype", "endpoint_name", "data_type", "timeframe", "extraction_window", "slot", "member", "i", F.coalesce(*made).alias("record"))


def raw_payloads(spark: SparkSession, timeframes: list[str] | None = None, providers: list[str] | None = None) -> DataFrame:
    """One row a slot: its response as the provider would send it. A slot has at most 600 records."""
    rows = records(spark, timeframes, providers)
    keys = [c for c in rows.columns if c not in {"i", "record"}]
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "record"))).alias("r"))
    data = F.concat(F.lit("["), F.array_join("r.record", ","), F.lit("]"))
    window = F.when(F.col("slot").endswith("m"), "minute").when(F.col("slot").endswith("h"), "hour").when(F.col("slot").endswith("d"), "day").otherwise(F.col("slot"))
    text = (
        F.when(F.col("folder") == "coinglass", F.concat(F.lit('{"code":"0","msg":"success","data":'), data, F.lit("}")))
        .when(F.col("folder") == "cryptoquant", F.concat(F.lit('{"status":{"code":200,"message":"success"},"result":{"window":"'), window, F.lit('","data":'), data, F.lit("}}")))
        .when(F.col("folder") == "glassnode", data)
        .otherwise(F.concat(F.lit('{"provider":"'), F.col("provider"), F.lit('","index":"'), F.col("subtype"), F.lit('","data":'), data, F.lit("}")))
    )
    return listed.select(*keys, text.alias("response"), F.size("r").alias("n_records"))


def write_zip(payloads: DataFrame, path: str) -> int:
    """Responses of one provider as members of a ZIP file on the driver (at most some hundred small members)."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        n = 0
        for r in payloads.select("member", "response").orderBy("member").toLocalIterator():
            z.writestr(r["member"], r["response"])
            n += 1
    return n


def validate_zip(spark: SparkSession, data: bytes, folder: str, timeframes: list[str] | None = None) -> list[str]:
    """What is wrong with a provider's ZIP: unknown, missing, short or misshapen members."""
    import json

    expected = {r["member"]: r["supports_timeframe"] for r in slots(registry(spark).where(F.col("folder") == folder), timeframes).select("member", "supports_timeframe").collect()}
    errors = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.endswith(".json")]
        for n in names:
            if n not in expected:
                errors.append(f"{n}: no matching endpoint")
                continue
            try:
                p = json.loads(z.read(n))
            except json.JSONDecodeError as e:
                errors.append(f"{n}: invalid JSON: {e}")
                continue
            found = p if isinstance(p, list) else p.get("data", p.get("result", {}).get("data") if isinstance(p.get("result"), dict) else None)
            if (folder == "glassnode") != isinstance(p, list) or found is None:
                errors.append(f"{n}: invalid shape")
            elif expected[n] and len(found) < ROWS["timeframe"]:
                errors.append(f"{n}: {len(found)} records < {ROWS['timeframe']}")
    return errors + [f"{n}: missing from ZIP" for n in sorted(set(expected) - set(names))]
