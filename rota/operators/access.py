"""Existence-driven operators: semi-joins, per-owner flags, allow-lists, rule lookup.

Every branch is reduced to one row per owner (or per owner and location)
with partial aggregation before it meets the driving table, so the joins that
assemble a report are one-to-one on the owner key and cannot fan out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rota.functions.columns import bit_or, flag_text, sorted_array
from rota.session import cut_lineage

# Flag columns of the location master and of the mapping.
LOCATION_FLAGS = ("IPCheckEnabled", "LocationCheckEnabled", "IPCheckEnabledOnMobile")
MAPPING_FLAGS = ("PunchIn", "PunchOut")

# The rule group and attribute names used for pre/post time.
RULE_GROUP = "Shift Properties"
RULE_ATTRIBUTES = {"PreTime": "Pre Time Minutes", "PostTime": "Post Time"}


def owners_with(driving: DataFrame, facts: DataFrame, driving_key: str,
                fact_key: str) -> DataFrame:
    """``WHERE EXISTS (SELECT 1 FROM facts WHERE fact_key = driving_key)``.

    The fact keys are de-duplicated first (partial aggregation collapses a hot
    key inside each map task), then a left-semi join keeps driving rows; it
    never multiplies them.
    """
    keys = facts.select(F.col(fact_key).alias("_k")).distinct()
    return driving.join(keys, driving[driving_key] == keys["_k"], "left_semi")


def first_owners_with(driving: DataFrame, facts: DataFrame, driving_key: str, fact_key: str,
                      n: int, block: int | None = None) -> DataFrame:
    """``owners_with(...)`` ordered by the driving key, first ``n`` rows, candidates first.

    The next block of driving rows in key order is taken, and EXISTS is tested for
    its key range alone, so the scan of ``facts`` carries that range as a filter and
    moves only the keys of a few blocks. Blocks (``block`` rows, default ``4 n``) grow
    fourfold until ``n`` rows are sure or the driving rows end; equal keys are never
    cut apart, NULL keys have no facts. Exact, and each round brings the driver
    three numbers."""
    size, after, found, have = max(block or 4 * n, 1), None, None, 0
    key = F.col(driving_key)
    rest = driving.where(key.isNotNull())
    while have < n:
        ahead = rest if after is None else rest.where(key > F.lit(after))
        head = ahead.select(driving_key).orderBy(key).limit(size)
        edge = head.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).first()
        if not edge["n"]:
            break
        inside = lambda c: F.col(c).between(F.lit(edge["low"]), F.lit(edge["high"]))
        hits = cut_lineage(owners_with(ahead.where(inside(driving_key)), facts.where(inside(fact_key)),
                                       driving_key, fact_key))
        found, have = hits if found is None else found.unionAll(hits), have + hits.count()
        after, size = edge["high"], size * 4
        if edge["n"] < size // 4:
            break
    return (driving.limit(0) if found is None else found).orderBy(driving_key).limit(n)


def mapped_locations(mapping: DataFrame, locations: DataFrame, owner: str = "EmployeeCode",
                     location: str = "LocationID", location_id: str = "ID",
                     columns: Sequence[str] = ()) -> DataFrame:
    """Mapping rows whose location has a master row, with master ``columns``
    attached (inner join on the location id)."""
    master = locations.select(F.col(location_id).alias(location), *columns)
    return mapping.join(master, location, "inner")


def access_flags(mapping: DataFrame, locations: DataFrame, owner: str = "EmployeeCode",
                 location: str = "LocationID", location_id: str = "ID",
                 reduced: bool = False) -> DataFrame:
    """Per owner, ``'true'`` when any mapped location (with a master row) has
    the flag set, else ``'false'``: (owner, IPCheckEnabled, LocationCheckEnabled,
    IPCheckEnabledOnMobile, PunchIn, PunchOut). Owners without mapped locations
    have no row; ``attach_flags`` fills them with ``'false'``. ``reduced``: the
    mapping has one row per (owner, location) already (``location_pairs``)."""
    pairs = mapping if reduced else _flag_bits(mapping, [owner, location])
    joined = mapped_locations(pairs.select(owner, location, *MAPPING_FLAGS), locations,
                              owner, location, location_id, LOCATION_FLAGS)
    flags = (*LOCATION_FLAGS, *MAPPING_FLAGS)
    agg = joined.groupBy(owner).agg(*[bit_or(c).alias(c) for c in flags])
    return agg.select(owner, *[flag_text(c).alias(c) for c in flags])


def _flag_bits(mapping: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mapping's flags, one row per key: what meets the location master, so that
    a location's many raw rows are collapsed map-side and never move to it."""
    return mapping.groupBy(*keys).agg(*[bit_or(c).alias(c) for c in MAPPING_FLAGS])


def attach_flags(driving: DataFrame, flags: DataFrame, driving_key: str,
                 owner: str = "EmployeeCode") -> DataFrame:
    """``CROSS APPLY`` of a correlated scalar aggregate: exactly one flag row
    per driving row, ``'false'`` where the owner has no mapping."""
    names = [c for c in flags.columns if c != owner]
    right = flags.withColumnRenamed(owner, "_owner")
    joined = driving.join(right, driving[driving_key] == right["_owner"], "left")
    return joined.select(*driving.columns,
                         *[F.coalesce(F.col(c), F.lit("false")).alias(c) for c in names])


def access_flags_global(mapping: DataFrame, locations: DataFrame,
                        location: str = "LocationID", location_id: str = "ID") -> DataFrame:
    """The flags over the whole mapping, ignoring the owner: exactly one row,
    also on empty input."""
    joined = mapped_locations(_flag_bits(mapping, [location]), locations,
                              location=location, location_id=location_id,
                              columns=LOCATION_FLAGS)
    flags = (*LOCATION_FLAGS, *MAPPING_FLAGS)
    return joined.agg(*[flag_text(bit_or(c)).alias(c) for c in flags])


def attach_global_flags(driving: DataFrame, mapping: DataFrame, locations: DataFrame,
                        location: str = "LocationID", location_id: str = "ID") -> DataFrame:
    """Attach the one global flag row to every driving row.

    The five flags come from one scalar subquery returning a struct: the
    aggregate runs once and its value is inlined into the projection, so no
    join and no pairing of rows happens.
    """
    joined = mapped_locations(_flag_bits(mapping, [location]), locations,
                              location=location, location_id=location_id,
                              columns=LOCATION_FLAGS)
    flags = (*LOCATION_FLAGS, *MAPPING_FLAGS)
    row =joined.agg(F.struct(*[bit_or(c).alias(c) for c in flags])).scalar()
    return driving.select(*driving.columns, *[flag_text(row[c]).alias(c) for c in flags])


def owner_location_ids(mapping: DataFrame, locations: DataFrame, owner: str = "EmployeeCode",
                       location: str = "LocationID", location_id: str = "ID") -> DataFrame:
    """``SELECT DISTINCT location`` of each owner's mapping rows that have a
    location master row: (owner, location)."""
    pairs = mapping.select(owner, location).distinct()
    master = locations.select(F.col(location_id).alias(location)).distinct()
    return pairs.join(master, location, "left_semi")


def allow_list(ip_ranges: DataFrame, mapping: DataFrame, locations: DataFrame,
               owner: str = "EmployeeCode", location: str = "LocationID",
               location_id: str = "ID", ip_location: str = "GeoConfigurationID",
               fields: Sequence[str] = ("IPFrom", "IPTo"), out: str = "IPRange") -> DataFrame:
    """IP rows whose location id is ``IN`` the owner's mapped locations, as one
    array per owner: (owner, out). Two mapping rows at one location do not
    repeat its IP rows; equal IP rows are both kept. Elements are ordered by
    location id, then by ``fields``.

    IP rows stay flat through the join with the distinct (owner, location)
    pairs: no task holds all rows of a location (a skewed one is split by AQE),
    and only the owner's own list is gathered, once.
    """
    ids = owner_location_ids(mapping, locations, owner, location, location_id)
    rows = ip_ranges.select(F.col(ip_location).alias(location), *fields)
    return (ids.join(rows, location, "inner")
            .groupBy(owner).agg(sorted_array(location, *fields).alias("_ips"))
            .select(owner, F.transform("_ips", lambda e: F.struct(*[e[f].alias(f) for f in fields]))
                    .alias(out)))


def allow_list_sets(ip_ranges: DataFrame, mapping: DataFrame, locations: DataFrame,
                    owner: str = "EmployeeCode", location: str = "LocationID",
                    location_id: str = "ID", ip_location: str = "GeoConfigurationID",
                    fields: Sequence[str] = ("IPFrom", "IPTo"), out: str = "IPRange",
                    key: str = "LocationSet") -> tuple[DataFrame, DataFrame]:
    """``allow_list`` in two parts: (owner, key) and (key, out). ``key`` is the owner's
    sorted set of mapped locations; each distinct set has its IP rows gathered once,
    however many owners share it, so rows do not grow with owners x IP rows.
    ``allow_list_of`` joins both to ``allow_list``; owners whose locations have no IP
    rows are in the first part alone."""
    ids = owner_location_ids(mapping, locations, owner, location, location_id)
    owners = ids.groupBy(owner).agg(F.sort_array(F.collect_set(location)).alias(key))
    rows = ip_ranges.select(F.col(ip_location).alias(location), *fields)
    sets = owners.select(key).distinct()
    lists = (sets.withColumn(location, F.explode(key)).join(rows, location, "inner")
             .groupBy(key).agg(sorted_array(location, *fields).alias("_ips"))
             .select(key, F.transform("_ips", lambda e: F.struct(*[e[f].alias(f) for f in fields]))
                     .alias(out)))
    return owners, lists


def allow_list_of(owners: DataFrame, lists: DataFrame, key: str = "LocationSet") -> DataFrame:
    """The parts of ``allow_list_sets`` joined: (owner, out). The narrow owners are
    hashed and the wide lists streamed past them, so that no task sorts or holds
    the lists of its partition."""
    return owners.hint("shuffle_hash").join(lists, key).drop(key)


def collated(df: DataFrame, columns: Sequence[str], collation: str = "UTF8_LCASE") -> DataFrame:
    """``df`` with text ``columns`` under a collation: joins, grouping, DISTINCT and
    comparisons on them then follow it (``UTF8_LCASE``: case does not count). Both
    sides of a comparison need it. The default everywhere is binary comparison."""
    return df.withColumns({c: F.collate(F.col(c), collation) for c in columns})


def rule_lookup(rules: DataFrame, org: str, key: str = "ShiftID",
                attributes: Mapping[str, str] | None = None,
                group: str = RULE_GROUP, value: str = "RuleItemValue",
                org_col: str = "Org6", group_col: str = "RuleRelatedTo",
                attr_col: str = "RuleConfigAttrItemName",
                end_col: str = "RuleEndDate") -> DataFrame:
    """Value of the open rule (no end date) per key and attribute for one
    organisation and rule group: (key, one column per attribute). Several
    matching rows: the smallest value (a deterministic pick). All attributes
    come out of one scan and one grouped aggregate."""
    attrs = dict(attributes or RULE_ATTRIBUTES)
    open_rules = rules.where(
        F.col(end_col).isNull()
        & (F.col(org_col) == org)
        & (F.col(group_col) == group)
        & F.col(attr_col).isin(list(attrs.values())))
    return open_rules.groupBy(key).agg(
        *[F.min(F.when(F.col(attr_col) == name, F.col(value))).alias(out)
          for out, name in attrs.items()])
