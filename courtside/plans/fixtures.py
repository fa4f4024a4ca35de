"""Sports tables derived from the given parquet tables, twice: as DataFrames and as SQL.

Everything is integer arithmetic over the keys of the given tables, so both engines
derive the same rows and every row count grows with the input.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from courtside.plans.registry import cte
from courtside.schema import MATCH_COLUMNS

TODAY = "1998-06-15"
EVENT_WORDS = ("Major", "P1", "P2", "Gold", "Silver", "Bronze", "Liga", "Open")
ROUND_OF_PRIORITY = {
    "1-URGENT": "Final", "2-HIGH": "Semifinals", "3-MEDIUM": "Quarterfinals", "4-NOT SPECIFIED": "Round of 16",
}


def today() -> Column:
    return F.lit(TODAY).cast("date")


def pick(i: Column, *values: str | None) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def season(k: Column) -> Column:
    """Seasons hold up to two hundred rows each, so their number grows with the data."""
    return (2000 + k % 10 + 10 * F.floor(k / 2000)).cast("int")


class Fixtures:
    """Lazy derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- history -----------------------------------------------------------------
    @cached_property
    def tournaments(self) -> DataFrame:
        c, n = self.table("customer"), self.table("nation")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            F.col("c_custkey").alias("tkey"), F.col("c_name").alias("name"), F.col("n_name").alias("federation")
        )

    @cached_property
    def matches(self) -> DataFrame:
        k = F.col("o_orderkey")
        rounds = F.coalesce(
            F.try_element_at(F.create_map(*[F.lit(x) for kv in ROUND_OF_PRIORITY.items() for x in kv]), F.col("o_orderpriority")),
            F.lit("Round of 32"),
        )
        status = F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "P", "live").otherwise("upcoming")
        done = F.col("o_orderstatus") == "F"
        return self.table("orders").select(
            k.alias("id"), F.col("o_custkey").alias("tkey"), F.col("o_orderdate").cast("date").alias("match_date"),
            F.when(F.col("o_custkey") % 2 == 0, "Men").otherwise("Women").alias("class"), rounds.alias("round"),
            status.alias("status"), F.when(done, (1 + k % 2).cast("int")).alias("winner_side"),
            F.when(done, score_text(k)).alias("score"),
        )

    @property
    def n_players(self) -> Column:
        return self.table("supplier").agg(F.count("*")).scalar()

    @cached_property
    def match_players(self) -> DataFrame:
        k = F.col("o_orderkey")
        o = self.table("orders").select(
            k, "o_custkey", "o_orderstatus", F.explode(F.array(*[F.lit(j) for j in range(4)])).alias("j")
        )
        side = (F.floor(F.col("j") / 2) + 1).cast("int")
        won = (F.col("o_orderstatus") == "F") & (1 + k % 2 == side)
        return o.select(
            k.alias("match_id"), side.alias("side"), (F.col("j") % 2 + 1).cast("int").alias("pos"),
            player_no(k, F.col("o_custkey"), F.col("j"), self.n_players).alias("player_id"),
            F.when(won, 1).otherwise(0).alias("is_winner"),
        )

    @cached_property
    def players(self) -> DataFrame:
        s, n = self.table("supplier"), self.table("nation")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("country")
        )

    # --- feed ------------------------------------------------------------------------
    @cached_property
    def feed(self) -> DataFrame:
        """Nested matches; see the SQL twin `fx_feed` for the flat columns."""
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
        k, ck = F.col("o_orderkey"), F.col("o_custkey")
        source = pick(k % 3, "rankedin", "fip", "tournamentsoftware")
        fip = k % 3 == 1
        status = F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "P", "live").otherwise("upcoming")
        up = F.col("o_orderstatus") == "O"
        rounds = F.coalesce(
            F.try_element_at(F.create_map(*[F.lit(x) for kv in ROUND_OF_PRIORITY.items() for x in kv]), F.col("o_orderpriority")),
            F.lit("Group A"),
        )
        cls = pick(ck % 3, "Men", "Women", None)
        hour = F.lpad((k % 24).cast("string"), 2, "0")
        d = F.col("o_orderdate")
        nums = self.n_players
        name = lambda i: F.concat(F.lit("Player P"), player_no(k, ck, F.lit(i), nums).cast("string"))
        player = lambda i: F.struct(name(i).alias("name"), pick(k % 4, "ESP", "ARG", ".JPG", "dk").alias("country"))
        team = lambda a, b: F.struct(F.concat_ws(" / ", name(a), name(b)).alias("name"), F.array(player(a), player(b)).alias("players"))
        cell = lambda x: x.cast("string")
        set_ = lambda a, b: F.struct(cell(a).alias("a"), cell(b).alias("b"))
        sets = F.when(status == "final", F.array(set_(F.lit(6), k % 5), set_(F.lit(6), (k + 2) % 5))).when(
            status == "live", F.array(set_(k % 7, k % 5))
        ).otherwise(F.array().cast("array<struct<a:string,b:string>>"))
        none = F.lit(None)
        out = j.select(
            k.alias("ordinal"), F.concat_ws(":", source, k.cast("string")).alias("id"), source.alias("source"),
            F.when(fip, "FIP").otherwise(F.col("n_name")).alias("federation"),
            F.struct(
                ck.cast("string").alias("id"),
                F.concat_ws(" ", "c_mktsegment", pick(ck % 8, *EVENT_WORDS), ck.cast("string")).alias("name"),
                F.concat(F.lit("/t/"), ck.cast("string")).alias("url"),
                F.when(ck % 2 == 0, F.concat(F.lit("Hall "), ck.cast("string"))).alias("venue"),
                F.when(ck % 3 == 0, F.col("n_name")).alias("address"),
                F.when(ck % 5 == 0, F.concat(F.lit("Club "), ck.cast("string"))).alias("organizer"),
                F.when(ck % 10 == 0, F.concat(F.lit("/club/"), ck.cast("string"))).alias("organizer_url"),
                none.alias("ranking"), d.cast("date").alias("start"), F.date_add(d.cast("date"), 3).alias("end"),
            ).alias("tournament"),
            cls.alias("class_name"), F.when(cls.isNull(), F.concat(F.lit("Men "), rounds)).otherwise(rounds).alias("round"),
            F.concat(F.lit("Court "), (k % 4 + 1).cast("string")).alias("court"), status.alias("status"),
            F.when(~fip & (k % 13 != 0), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T"), hour, F.lit(":00:00"))).alias("start_time"),
            F.when(fip & up, pick(k % 4, "Not before 3:00 PM", "Followed by", "Starting at 10:00 AM", None)).alias("schedule"),
            F.when(fip & up & (k % 5 == 0), F.concat(hour, F.lit(":30"))).alias("est_start"),
            none.alias("est_start_at"),
            F.when(fip, F.struct((k % 7 + 1).cast("int").alias("n"), F.upper(F.date_format(d, "MMM dd EEE")).alias("label"))).alias("day"),
            F.array(team(0, 1), team(2, 3)).alias("teams"),
            F.struct(sets.alias("sets"), F.when(status == "final", (k % 2).cast("int")).alias("winner")).alias("score"),
        )
        typed = [F.col(c).cast(t).alias(c) for c, t in MATCH_COLUMNS.items()]
        return out.select("ordinal", *typed)

    # --- snapshots, sources, rankings from events -------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        status = F.when(F.col("event_type") == "click", "live").when(F.col("event_type") == "purchase", "final").otherwise("upcoming")
        return self.table("events").withColumn("status", status)

    @cached_property
    def snapshots(self) -> DataFrame:
        """One snapshot per day: the last event of each user that day."""
        day = F.date_trunc("day", "ts").cast("timestamp_ntz")
        e = self.events.where("event_type <> 'error'").withColumn("snapshot_at", day)
        last = e.groupBy("snapshot_at", F.col("user_id").alias("id")).agg(
            F.max_by(F.struct("status", "value", F.col("event_id").alias("ordinal")), "event_id").alias("e")
        ).select("snapshot_at", "id", "e.*")
        est = F.col("snapshot_at") + F.make_dt_interval(mins=(F.floor("value") % 40).cast("int"))
        return last.withColumn("est_start_at", est.cast("timestamp_ntz"))

    @cached_property
    def source_status(self) -> DataFrame:
        return self.table("events").select(
            (F.col("user_id") % 5).alias("source"), F.col("ts").alias("snapshot_at"), F.col("event_id").alias("ordinal"),
            (F.col("event_type") != "error").alias("ok"), F.floor("value").cast("int").alias("match_count"),
            F.when(F.col("event_type") == "error", "timeout").alias("error"),
        )

    @cached_property
    def ranking_rows(self) -> DataFrame:
        """Daily lists per event type, ranked by points then player."""
        from pyspark.sql import Window

        day = F.date_trunc("day", "ts").cast("timestamp_ntz")
        pts = self.table("events").groupBy(day.alias("snapshot_at"), F.col("event_type").alias("fed"), "user_id").agg(
            F.round(F.sum("value"), 2).alias("points")
        )
        w = Window.partitionBy("snapshot_at", "fed").orderBy(F.col("points").desc(), "user_id")
        u = F.col("user_id")
        return pts.select(
            "snapshot_at", "fed", F.when(u % 2 == 0, "men").otherwise("women").alias("category"),
            F.row_number().over(w).alias("rank"), F.when(u % 17 != 0, u).alias("id"),
            F.concat(F.lit("Player P"), u.cast("string")).alias("name"), F.concat(F.lit("C"), (u % 4).cast("string")).alias("country"),
            "points", F.concat(F.lit("Club "), (u % 6).cast("string")).alias("club"),
        ).withColumn("ordinal", F.col("rank"))

    @cached_property
    def last_lists(self) -> DataFrame:
        """The newest daily lists."""
        rows = self.ranking_rows
        newest = rows.agg(F.max("snapshot_at")).scalar()
        return rows.where(F.col("snapshot_at") == newest)

    @cached_property
    def no1(self) -> DataFrame:
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        r = self.table("region")
        counts = (
            o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .groupBy(F.year("o_orderdate").alias("year"), F.when(F.col("o_custkey") % 2 == 0, "Men").otherwise("Women").alias("gender"), "r_name")
            .agg(F.count("*").alias("n"))
        )
        return counts.groupBy("year", "gender").agg(F.min_by("r_name", F.struct(-F.col("n"), "r_name")).alias("pair")).withColumn(
            "authority", F.when(F.col("year") < 1998, "APA").otherwise("FIP")
        )

    @cached_property
    def subscriptions(self) -> DataFrame:
        ck = F.col("c_custkey")
        p = (ck % self.n_players).cast("string")
        t = (ck + 1).cast("string")
        good = F.concat(
            F.lit('{"players":{"'), p, F.lit('":{"name":"Player P'), p, F.lit('"}},"tournaments":{"fip:'), t, F.lit('":{"name":"T"}}}')
        )
        return self.table("customer").select(
            ck.alias("endpoint"), F.when(ck % 50 == 49, F.lit("{broken")).otherwise(good).alias("follows")
        )

    # --- archive -------------------------------------------------------------------------------
    @cached_property
    def archive_names(self) -> DataFrame:
        k = F.col("p_partkey")
        year = season(k)
        return self.table("part").select(
            F.concat(F.lit("t-"), k.cast("string")).alias("key"), k.alias("ordinal"), year.alias("year"),
            F.when(k % 9 == 0, None).otherwise(F.concat(F.col("p_brand"), F.lit(" (x)"))).alias("city"), F.col("p_name").alias("name"),
            F.when(k % 7 == 0, None).otherwise(F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.col("p_size"))).alias("start"),
        )

    @cached_property
    def final_rows(self) -> DataFrame:
        k = F.col("p_partkey")
        year = season(k)
        return self.table("part").select(
            k.alias("row_id"), k.alias("ordinal"), year.alias("year"), F.when(k % 8 == 0, "").otherwise(F.upper("p_brand")).alias("city"),
            F.concat(F.upper("p_name"), F.lit(" Open")).alias("name"),
            F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.col("p_size") + (F.col("p_size") % 5)).alias("final_date"),
        )

    @cached_property
    def archive_index(self) -> DataFrame:
        """Tournament list rows: one per customer with orders."""
        o, c, n = self.table("orders"), self.table("customer"), self.table("nation")
        span = o.groupBy("o_custkey").agg(
            F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("end"), F.count("*").alias("n")
        )
        ck = F.col("c_custkey")
        fed = F.when(ck % 3 == 0, "FIP").otherwise(F.col("n_name"))
        return span.join(c, span.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
            F.concat(F.lit("rin-"), ck.cast("string")).alias("key"),
            F.concat_ws(" ", "c_mktsegment", pick(ck % 8, *EVENT_WORDS), ck.cast("string")).alias("name"),
            fed.alias("federation"), F.when((ck % 3 == 0) & (ck % 2 == 0), "WPT").alias("tour"), F.lit("rin").alias("source"),
            "start", "end", "n", ck.alias("ordinal"),
        )

    # --- draws --------------------------------------------------------------------------------------
    @cached_property
    def draw_cells(self) -> DataFrame:
        """A bracket of eight pairs per customer as cells, header in row 0; scores beside the winners."""
        ck = F.col("c_custkey")
        base = self.table("customer").select(
            F.concat(F.lit("/wpt/2015/marzo/c"), ck.cast("string"), F.lit("/")).alias("path"),
            F.when(ck % 2 == 0, "Men").otherwise("Women").alias("gender"), ck.alias("ck"),
        )
        ck, j = F.col("ck"), F.col("j")

        def part(n: int, r: Column, c: int, lines: Column, is_name: bool) -> DataFrame:
            each = base.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
            return each.select(
                "path", "gender", r.cast("int").alias("r"), F.lit(c).alias("c"), lines.alias("lines"), F.lit(is_name).alias("is_name")
            )

        score = lambda shift: F.array(F.concat(F.lit("6/4 6/"), ((ck + j + shift) % 5).cast("string")))
        heads = [part(1, F.lit(0), c, F.array(F.lit(t)), False) for c, t in enumerate(("Cuartos", "Semifinales", "Final"))]
        parts = [
            part(8, 1 + 2 * j, 0, draw_lines(ck, j), True), part(4, 2 + 4 * j, 1, draw_lines(ck, first_winner(ck, j)), True),
            part(4, 3 + 4 * j, 1, score(0), False), part(2, 4 + 8 * j, 2, draw_lines(ck, second_winner(ck, j)), True),
            part(2, 5 + 8 * j, 2, score(4), False),
        ]
        rows = reduce(DataFrame.unionByName, heads + parts)
        return rows.withColumn("text", F.concat_ws(" ", "lines"))

    @cached_property
    def draw_pages(self) -> DataFrame:
        """The same brackets as HTML pages, inside a layout table; the header has a column span.

        A page is written from its customer alone, so only keys are shuffled, whatever the number of cells.
        """
        ck = F.col("ck")
        td = lambda lines: F.concat(F.lit("<td>"), F.concat_ws("<br />", lines), F.lit("</td>"))
        pair = lambda p: F.concat(F.lit('<td bgcolor="#000000" class="primera">'), F.concat_ws("<br />", draw_lines(ck, p)), F.lit("</td>"))
        score = lambda n: td(F.array(F.concat(F.lit("6/4 6/"), ((ck + n) % 5).cast("string"))))
        cells = {(0, c): td(F.array(F.lit(t))) for c, t in enumerate(("Cuartos", "Semifinales", "Final"))}
        cells |= {(1 + 2 * j, 0): pair(F.lit(j)) for j in range(8)}
        cells |= {(2 + 4 * j, 1): pair(first_winner(ck, F.lit(j))) for j in range(4)} | {(3 + 4 * j, 1): score(j) for j in range(4)}
        cells |= {(4 + 8 * j, 2): pair(second_winner(ck, F.lit(j))) for j in range(2)} | {(5 + 8 * j, 2): score(j + 4) for j in range(2)}
        # blank rows keep the row numbers of the cells
        filled = {r for r, _ in cells}
        line = [
            F.concat(F.lit("<tr>"), *[cells.get((r, c), F.lit("<td></td>")) for c in range(3)], F.lit("</tr>")) if r in filled
            else F.lit("<tr><td></td></tr>") for r in range(16)
        ]
        page = F.concat(
            F.lit("<html><body><table><tr><td>menu</td><td><table border=0>"), *line, F.lit("</table></td></tr></table></body></html>"),
        )
        once = self.table("customer").select(F.col("c_custkey").alias("ck")).distinct()
        return once.select(
            F.concat(F.lit("/wpt/2015/marzo/c"), ck.cast("string"), F.lit("/")).alias("path"),
            F.when(ck % 2 == 0, "Men").otherwise("Women").alias("gender"), page.alias("html"),
        )


def first_winner(ck: Column, j: Column) -> Column:
    """Pair that wins first-round match j of a customer's draw."""
    return 2 * j + (ck + j) % 2


def second_winner(ck: Column, j: Column) -> Column:
    return F.when((ck + j) % 3 == 0, first_winner(ck, 2 * j)).otherwise(first_winner(ck, 2 * j + 1))


def draw_pair(ck: Column, p: Column) -> Column:
    tag = F.concat(ck.cast("string"), F.lit("x"), p.cast("int").cast("string"))
    return F.array(F.concat(F.lit("Ana P"), tag), F.concat(F.lit("Bea Q"), tag))


def draw_lines(ck: Column, p: Column) -> Column:
    return F.concat(draw_pair(ck, p), F.array(F.lit("(esp-arg)")))


def score_text(k: Column) -> Column:
    s = lambda x: x.cast("string")
    even = F.concat(
        F.lit("6-"), s(k % 5), F.when(k % 3 == 0, " 4-6").otherwise(""),
        F.when(k % 11 == 0, F.lit(" 7-66")).otherwise(F.concat(F.lit(" 6-"), s((k + 2) % 5))),
    )
    odd = F.concat(
        s(k % 5), F.lit("-6"), F.when(k % 3 == 0, " 6-4").otherwise(""),
        F.when(k % 11 == 0, F.lit(" 66-7")).otherwise(F.concat(F.lit(" "), s((k + 2) % 5), F.lit("-6"))),
    )
    return F.when(k % 2 == 0, even).otherwise(odd)


def player_no(k: Column, ck: Column, j: Column, n: Column) -> Column:
    return (ck * 3 + k % 7 + j * (1 + k % 3)) % n


# --- SQL twins -------------------------------------------------------------------------------------
_WORDS = ", ".join(f"'{w}'" for w in EVENT_WORDS)
_ROUND = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROUND_OF_PRIORITY.items())
_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'P' THEN 'live' ELSE 'upcoming' END"

cte("fx_tournaments", """
SELECT c_custkey AS tkey, c_name AS name, n_name AS federation
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
cte("fx_scores", """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 2 = 0
    THEN '6-' || (o_orderkey % 5) || CASE WHEN o_orderkey % 3 = 0 THEN ' 4-6' ELSE '' END
         || CASE WHEN o_orderkey % 11 = 0 THEN ' 7-66' ELSE ' 6-' || ((o_orderkey + 2) % 5) END
    ELSE (o_orderkey % 5) || '-6' || CASE WHEN o_orderkey % 3 = 0 THEN ' 6-4' ELSE '' END
         || CASE WHEN o_orderkey % 11 = 0 THEN ' 66-7' ELSE ' ' || ((o_orderkey + 2) % 5) || '-6' END
  END AS score
FROM orders WHERE o_orderstatus = 'F'""")
cte("fx_matches", f"""
SELECT o_orderkey AS id, o_custkey AS tkey, CAST(o_orderdate AS DATE) AS match_date,
       CASE WHEN o_custkey % 2 = 0 THEN 'Men' ELSE 'Women' END AS class,
       {_ROUND} ELSE 'Round of 32' END AS round, {_STATUS} AS status,
       CASE WHEN o_orderstatus = 'F' THEN CAST(1 + o_orderkey % 2 AS INT) END AS winner_side, s.score
FROM orders LEFT JOIN fx_scores s ON s.id = o_orderkey""", ("fx_scores",))
cte("fx_match_players", """
SELECT o_orderkey AS match_id, CAST(j // 2 + 1 AS INT) AS side, CAST(j % 2 + 1 AS INT) AS pos,
       (o_custkey * 3 + o_orderkey % 7 + j * (1 + o_orderkey % 3)) % n AS player_id,
       CASE WHEN o_orderstatus = 'F' AND 1 + o_orderkey % 2 = j // 2 + 1 THEN 1 ELSE 0 END AS is_winner
FROM orders CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(j) CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) AS s""")
cte("fx_players", """
SELECT s_suppkey AS id, s_name AS name, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
cte("fx_appearances", """
SELECT mp.*, m.tkey, m.match_date, m.class, m.round, m.status, m.winner_side, m.score
FROM fx_match_players mp JOIN fx_matches m ON m.id = mp.match_id""", ("fx_match_players", "fx_matches"))
cte("fx_feed", f"""
SELECT o_orderkey AS k, o_custkey AS ck, o_orderkey AS ordinal,
  ['rankedin','fip','tournamentsoftware'][o_orderkey % 3 + 1] || ':' || o_orderkey AS id,
  ['rankedin','fip','tournamentsoftware'][o_orderkey % 3 + 1] AS source,
  CASE WHEN o_orderkey % 3 = 1 THEN 'FIP' ELSE n_name END AS federation,
  CAST(o_custkey AS VARCHAR) AS tid,
  c_mktsegment || ' ' || [{_WORDS}][o_custkey % 8 + 1] || ' ' || o_custkey AS tname,
  [{_WORDS}][o_custkey % 8 + 1] AS word,
  CASE WHEN o_custkey % 3 = 0 THEN 'Men' WHEN o_custkey % 3 = 1 THEN 'Women' END AS class_name,
  {_ROUND} ELSE 'Group A' END AS base_round,
  CASE WHEN o_custkey % 3 = 2 THEN 'Men ' ELSE '' END || {_ROUND} ELSE 'Group A' END AS round,
  'Court ' || (o_orderkey % 4 + 1) AS court, {_STATUS} AS status,
  CASE WHEN o_orderkey % 3 <> 1 AND o_orderkey % 13 <> 0
       THEN strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00:00' END AS start_time,
  CASE WHEN o_orderkey % 3 = 1 AND o_orderstatus = 'O'
       THEN ['Not before 3:00 PM','Followed by','Starting at 10:00 AM',NULL][o_orderkey % 4 + 1] END AS schedule,
  CASE WHEN o_orderkey % 3 = 1 AND o_orderstatus = 'O' AND o_orderkey % 5 = 0
       THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30' END AS est_start,
  CAST(o_orderdate AS DATE) AS d, n_name,
  CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 7 + 1 END AS day_n,
  'Player P' || ((o_custkey * 3 + o_orderkey % 7) % n) AS p0,
  'Player P' || ((o_custkey * 3 + o_orderkey % 7 + (1 + o_orderkey % 3)) % n) AS p1,
  'Player P' || ((o_custkey * 3 + o_orderkey % 7 + 2 * (1 + o_orderkey % 3)) % n) AS p2,
  'Player P' || ((o_custkey * 3 + o_orderkey % 7 + 3 * (1 + o_orderkey % 3)) % n) AS p3
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
CROSS JOIN (SELECT COUNT(*) AS n FROM supplier) AS s""")
cte("fx_snapshots", """
SELECT snapshot_at, id, status, value, ordinal, snapshot_at + to_minutes(CAST(FLOOR(value) AS INT) % 40) AS est_start_at
FROM (
  SELECT date_trunc('day', ts)::TIMESTAMP AS snapshot_at, user_id AS id, value, event_id AS ordinal,
    CASE event_type WHEN 'click' THEN 'live' WHEN 'purchase' THEN 'final' ELSE 'upcoming' END AS status,
    row_number() OVER (PARTITION BY date_trunc('day', ts), user_id ORDER BY event_id DESC) AS rn
  FROM events WHERE event_type <> 'error') WHERE rn = 1""")
cte("fx_source_status", """
SELECT user_id % 5 AS source, ts AS snapshot_at, event_id AS ordinal, event_type <> 'error' AS ok,
       CAST(FLOOR(value) AS INT) AS match_count, CASE WHEN event_type = 'error' THEN 'timeout' END AS error FROM events""")
cte("fx_ranking_rows", """
SELECT snapshot_at, fed, CASE WHEN user_id % 2 = 0 THEN 'men' ELSE 'women' END AS category,
  row_number() OVER (PARTITION BY snapshot_at, fed ORDER BY points DESC, user_id) AS rank,
  CASE WHEN user_id % 17 <> 0 THEN user_id END AS id, 'Player P' || user_id AS name, 'C' || (user_id % 4) AS country,
  points, 'Club ' || (user_id % 6) AS club
FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS snapshot_at, event_type AS fed, user_id, round(sum(value), 2) AS points
      FROM events GROUP BY ALL)""")
cte("fx_last_lists", """
SELECT * FROM fx_ranking_rows WHERE snapshot_at = (SELECT max(snapshot_at) FROM fx_ranking_rows)""", ("fx_ranking_rows",))
cte("fx_no1", """
SELECT year, gender, pair, CASE WHEN year < 1998 THEN 'APA' ELSE 'FIP' END AS authority FROM (
  SELECT year(o_orderdate) AS year, CASE WHEN o_custkey % 2 = 0 THEN 'Men' ELSE 'Women' END AS gender, r_name AS pair,
    row_number() OVER (PARTITION BY year(o_orderdate), o_custkey % 2 ORDER BY count(*) DESC, r_name) AS rn
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY year(o_orderdate), o_custkey % 2, CASE WHEN o_custkey % 2 = 0 THEN 'Men' ELSE 'Women' END, r_name) WHERE rn = 1""")
cte("fx_archive_names", """
SELECT 't-' || p_partkey AS key, p_partkey AS ordinal, CAST(2000 + p_partkey % 10 + 10 * (p_partkey // 2000) AS INT) AS year,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END AS city, p_name AS name,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE make_date(CAST(2000 + p_partkey % 10 + 10 * (p_partkey // 2000) AS INT), 1, 1) + p_size END AS start FROM part""")
cte("fx_final_rows", """
SELECT p_partkey AS row_id, CAST(2000 + p_partkey % 10 + 10 * (p_partkey // 2000) AS INT) AS year,
  CASE WHEN p_partkey % 8 = 0 THEN '' ELSE p_brand END AS city, p_name AS name,
  make_date(CAST(2000 + p_partkey % 10 + 10 * (p_partkey // 2000) AS INT), 1, 1) + p_size + p_size % 5 AS final_date
FROM part""")
cte("fx_archive_index", f"""
SELECT 'rin-' || c_custkey AS key, c_mktsegment || ' ' || [{_WORDS}][c_custkey % 8 + 1] || ' ' || c_custkey AS name,
  [{_WORDS}][c_custkey % 8 + 1] AS word,
  CASE WHEN c_custkey % 3 = 0 THEN 'FIP' ELSE n_name END AS federation,
  CASE WHEN c_custkey % 6 = 0 THEN 'WPT' END AS tour, start, "end", n, c_custkey AS ordinal
FROM (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS start, CAST(max(o_orderdate) AS DATE) AS "end", count(*) AS n FROM orders GROUP BY 1)
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
