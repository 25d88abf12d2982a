"""Row filters: allowed hosts, robots rules, facets, query limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.scale import checkpointed, lookup_join
from siteloom.schemas import FILTER_FIELDS

# Limits of one query.
MAX_LENGTH = {"q": 1000, "language": 32, "section": 128, "kind": 32}
TOP_RANGE, TOP_DEFAULT = (1, 50), 20
SKIP_RANGE, SKIP_DEFAULT = (0, 1000), 0


def on_hosts(df: DataFrame, host: Column, hosts: list[str] | DataFrame) -> DataFrame:
    """Rows whose host is an allowed one or lies below it.

    A configured list is tested in the row. A DataFrame (column ``host``) is
    matched against the distinct hosts only, by equality on their suffixes,
    and the rows then keep the hosts that passed.
    """
    if not isinstance(hosts, DataFrame):
        listed = F.array(*[F.lit(h.lower()) for h in hosts]).cast("array<string>")
        return df.filter(F.arrays_overlap(U.host_suffixes(host), listed))
    marked = df.withColumn("_host", host)
    suffixes = marked.select("_host").distinct().select(
        "_host", F.explode(U.host_suffixes("_host")).alias("host"))
    allowed = hosts.select(F.lower("host").alias("host")).distinct()
    passed = suffixes.join(allowed, "host", "left_semi").select("_host").distinct()
    return lookup_join(marked, checkpointed(passed), ["_host"], "left_semi").drop("_host")


def allowed_domains(df: DataFrame, domains: list[str] | None = None,
                    seeds: DataFrame | None = None) -> DataFrame:
    """Keep URLs on the allowed domains; without a list, on the seeds' hosts."""
    if domains:
        return on_hosts(df, U.url_host("url"), domains)
    if seeds is None:
        raise ValueError("give domains or seeds")
    hosts = seeds.select(U.url_host("url").alias("host")).filter("host <> ''")
    return on_hosts(df, U.url_host("url"), hosts)


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(host, rules) from robots text, for the group that names the agent, or
    else for the ``*`` group. A rule is (allow, pattern)."""
    def directive(line: Column) -> Column:
        bare = F.trim(F.regexp_replace(line, "#.*$", ""))
        return F.struct(F.lower(F.trim(F.regexp_extract(bare, r"^([^:]*):", 1))).alias("field"),
                        F.trim(F.regexp_extract(bare, r"^[^:]*:(.*)$", 1)).alias("value"))

    known = F.filter(F.transform(F.split("body", r"\r\n|\r|\n"), directive),
                     lambda d: d.field.isin("user-agent", "allow", "disallow"))
    # Consecutive agent lines open one group; every rule line belongs to it.
    state = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("closed"),
                     F.array().cast("array<struct<agents:array<string>,allow:boolean,pattern:string>>")
                     .alias("rules"))

    def step(acc: Column, item: Column) -> Column:
        name = F.array(F.lower(item.value))
        opened = F.struct(
            F.when(acc.closed, name).otherwise(F.concat(acc.agents, name)).alias("agents"),
            F.lit(False).alias("closed"), acc.rules.alias("rules"))
        rule = F.struct(acc.agents.alias("agents"), (item.field == "allow").alias("allow"),
                        item.value.alias("pattern"))
        return F.when(item.field == "user-agent", opened).otherwise(F.struct(
            acc.agents.alias("agents"), F.lit(True).alias("closed"),
            F.array_append(acc.rules, rule).alias("rules")))

    every = robots.select("host", F.aggregate(known, state, step).rules.alias("rules"))
    mine = F.filter("rules", lambda r: F.exists(
        r.agents, lambda a: ~a.isin("", "*") & F.contains(F.lit(agent.lower()), a)))
    star = F.filter("rules", lambda r: F.array_contains(r.agents, "*"))
    chosen = F.when(F.size(mine) > 0, mine).otherwise(star)
    return every.select("host", F.transform(
        F.filter(chosen, lambda r: r.pattern != ""),
        lambda r: F.struct(r.allow.alias("allow"), r.pattern.alias("pattern"))).alias("rules"))


def _rule_matches(path: Column, pattern: Column) -> Column:
    """Prefix match; ``*`` stands for any run and ``$`` for the end."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+?^|])", r"\\$1")
    quoted = F.replace(F.regexp_replace(quoted, r"\$(?=.)", r"\\\$"), F.lit("*"), F.lit(".*"))
    plain = ~pattern.rlike(r"[*$]")
    return F.when(plain, F.startswith(path, pattern)).otherwise(
        F.regexp_like(path, F.concat(F.lit("(?s)^"), quoted)))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs their host's rules allow: the longest matching pattern decides,
    allow wins a tie, and no match means allowed.

    A host's rules sit in one array, so a URL row is never multiplied.
    """
    path = F.regexp_extract("url", rf"^(?:{U.SCHEME})?(?:{U.AUTHORITY})?([^#]*)", 1)
    joined = lookup_join(urls.withColumn("_host", U.url_host("url")),
                         rules.withColumnRenamed("host", "_host"), ["_host"], "left")
    joined = joined.withColumn("_path", F.when(path == "", F.lit("/")).otherwise(path))
    hits = F.filter("rules", lambda r: _rule_matches(F.col("_path"), r.pattern))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r.pattern), r.allow.alias("allow"))))
    return (joined.filter(F.coalesce(best["allow"], F.lit(True)))
            .drop("_host", "_path", "rules"))


def facet_filter(df: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """ANDed equality on language, section and kind; blank values are ignored."""
    unknown = set(filters) - set(FILTER_FIELDS)
    if unknown:
        raise ValueError(f"not filterable: {sorted(unknown)}")
    for field in FILTER_FIELDS:
        if filters.get(field):
            df = df.filter(F.col(field) == F.lit(filters[field]))
    return df


def validate_queries(queries: DataFrame) -> DataFrame:
    """Fill defaults and add ``error``: null, or the first limit broken."""
    top = F.coalesce(F.col("top"), F.lit(TOP_DEFAULT))
    skip = F.coalesce(F.col("skip"), F.lit(SKIP_DEFAULT))
    error = F.lit(None).cast("string")
    checks = [(F.length(F.col(c)) > n, f"{c} too long") for c, n in MAX_LENGTH.items()]
    checks += [(~top.between(*TOP_RANGE), "top out of range"),
               (~skip.between(*SKIP_RANGE), "skip out of range")]
    for broken, message in reversed(checks):
        error = F.when(broken, F.lit(message)).otherwise(error)
    return queries.withColumns({"q": F.coalesce(F.col("q"), F.lit("")), "top": top, "skip": skip,
                                "error": error})


def split_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) queries; a rejected one keeps its error."""
    checked = validate_queries(queries)
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")
