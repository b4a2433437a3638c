"""Shuffle sharding of tenants over cells or instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash60

#: Seeds of the assignment, in order. Changing one moves tenants.
HASH_SEEDS = (0x9E3779B9, 0x6C62272E, 0x94D049BB, 0xE9546B25, 0x12E15E35, 0x3B1D8F2B, 0x7C9E4AB3, 0x4F5A1C9F)


def candidate_seeds() -> list[int]:
    return [(s + i) % 2**32 for i, s in enumerate(HASH_SEEDS)]


def cells(tenant: Column, n: int, k: int) -> Column:
    """k distinct cells of n for a tenant: one candidate a seed, repeats passed over, then cells in order
    from 0, so that every k up to n ends."""
    h = hash60(tenant)
    probe = F.array(*[(h.bitwiseXOR(F.lit(s).cast("long")) % n).cast("int") for s in candidate_seeds()])
    return F.slice(F.array_distinct(F.concat(probe, F.sequence(F.lit(0), F.lit(n - 1)))), 1, k)


def owners(tenant: Column, fleet_size: int, k: int) -> Column:
    return cells(tenant, max(1, fleet_size), min(k, max(1, fleet_size)))


def owns(tenant: Column, instance: int, fleet_size: int, k: int) -> Column:
    """Whether an instance owns a tenant; a fleet of one owns all."""
    return F.lit(True) if fleet_size <= 1 else F.array_contains(owners(tenant, fleet_size, k), instance)


def redirect_hint(df: DataFrame, topology: DataFrame | None, fleet_size: int, k: int, tenant: str = "tenant_id") -> DataFrame:
    """df with `hint`: the addresses of a tenant's owners, comma-joined in owner order; '' without a
    topology or a fleet. The topology has one row an instance and meets the tenants, not the rows."""
    if topology is None or fleet_size <= 1:
        return df.withColumn("hint", F.lit(""))
    known = topology.filter(F.length("address") > 0).groupBy("id").agg(F.first("address").alias("address"))
    each = df.select(F.col(tenant).alias("_t")).distinct().select("_t", F.posexplode(owners(F.col("_t"), fleet_size, k)).alias("pos", "id"))
    hints = each.join(known, "id").groupBy("_t").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "address"))), lambda x: x["address"]), ",").alias("hint"))
    return df.join(hints, F.col(tenant) == F.col("_t"), "left").drop("_t").withColumn("hint", F.coalesce("hint", F.lit("")))


def topology_json(instance: int, fleet_size: int, k: int) -> str:
    import json

    return json.dumps({"instance_id": instance, "fleet_size": fleet_size, "instances_per_tenant": k}) if fleet_size > 1 else json.dumps({"fleet_routing": "disabled"})


def shared_owner_pairs(tenants: DataFrame, fleet_size: int, k: int, tenant: str = "tenant_id") -> DataFrame:
    """For each set of owners that several tenants have: how many tenants and pairs of them. Counted by
    set, so no pair is made."""
    sets = tenants.select(F.col(tenant).alias("t")).distinct().groupBy(F.array_join(F.array_sort(owners(F.col("t"), fleet_size, k)), ",").alias("owner_set")).agg(F.count(F.lit(1)).alias("tenants"))
    return sets.filter("tenants > 1").withColumn("pairs", (F.col("tenants") * (F.col("tenants") - 1) / 2).cast("long"))
