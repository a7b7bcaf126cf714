"""Best representative of each duplicate group.

Method: a latent two-sided quality model. Every value that a group's records give for a field is a claim that is
true of the person or not. A record speaks for the value it gives and, by its absence, against every other value of
the field that was current at the time: one seen before and again later, or the newest one so far; dates of birth do
not change, so there each other value speaks against. Each source system has a sensitivity (how often it gives a true
value) and a specificity (how seldom a false one), and each kind of claim a share of true ones, all found by
expectation-maximisation without bounds other than a count of one each way. The claim that first brings a value up is
no evidence for it: only what follows is. A field keeps every value judged true, in
order of first sight; the golden value is the one of them that began last, or the likeliest date of birth.

Kinds are what is seen on a claim, not a judgement of it: its form, a tag in the address, a domain one slip away from
a far more frequent one, other fans (or a large share of all) who give the value, a better supported value of the
group that it is a slip of, a word in an address that many fans' addresses have and nobody's name is, and whether an
address holds the person's names. What a kind is worth, the model learns. Records that give a slip or a
variant of a value also speak for that value.

Records are aggregated to a row per group, value, system and day before any window, and windows run over the days of a
group and field (at most one row a day), so a fan with a third of all records is neither gathered nor sorted. A slip is
found by equal keys (sorted letters, beginnings, ends) whose best supported value is taken by an aggregate, so no pairs
within a group are formed.

Defined results: records with a null or blank value make no claim; a fan_id with fewer than two records, a record
reference met twice, or a reference without a record count once or not at all; a claim without a time counts as the
first; ties go to the later last sight, then the greater value; the smallest rec_id with exactly the chosen value is
named. Extra columns are not read; empty tables give an empty result. A fit that does not settle is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.functions.text import spell_plain
from recordspark.runtime import Cut

MAX_ROUNDS, SETTLED = 300, 1e-3
SYSTEMS = {"email": ("crm", "ticketing", "merch", "email"), "phone": ("crm", "ticketing"), "dob": ("crm",)}
ALL_SYSTEMS = SYSTEMS["email"]
POPULAR = 0.005  # share of the fans with a field who give a value of the kind `popular`: at most 200 values a field
COMMON_WORD = 0.002  # share of the fans with an address whose addresses have a word: at most 500 words
NEAR_RATIO = 10  # times that a domain one slip away must be more frequent for a claim to be of the kind `near`
NO_DAY = -(10**6)


def _trim_lower(c: Column) -> Column:
    t = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(t != "", t)


def members(records: DataFrame, xref: DataFrame) -> DataFrame:
    """Records of every fan_id with two or more, each reference once."""
    refs = xref.filter("fan_id is not null and source_system is not null and source_record_id is not null").groupBy("source_system", "source_record_id").agg(F.min("fan_id").alias("fan_id"))
    cols = ["rec_id", "source_system", "source_record_id", "first_name", "last_name", "email", "phone", "city", "state", "zip", "dob", "birth_year", "observed_at"]
    own = records.filter("rec_id is not null").select(*cols).join(refs, ["source_system", "source_record_id"])
    large = own.groupBy("fan_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("fan_id")
    return own.join(large, "fan_id")


def near_domains(emails: DataFrame) -> DataFrame:
    """Domains one letter, or two swapped letters, away from one that is NEAR_RATIO times as frequent: they share a form with one letter left out."""
    d = emails.groupBy("domain").agg(F.count("*").alias("n"))
    less = F.transform(F.sequence(F.lit(1), F.length("domain")), lambda i: F.concat(F.left("domain", i - 1), F.substr("domain", i + 1)))
    keyed = d.select("domain", "n", F.explode(F.array_distinct(F.array_append(less, F.col("domain")))).alias("key"))
    top = keyed.groupBy("key").agg(F.max("n").alias("most"))
    return keyed.join(top, "key").filter(F.col("most") >= NEAR_RATIO * F.col("n")).select("domain").distinct().withColumn("near", F.lit(True))


def _words(email: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.split_part(email, F.lit("@"), F.lit(1)), F.lit("([a-z]{3,})"), F.lit(1)))


def common_words(claimed: DataFrame, names: DataFrame) -> DataFrame:
    """Words of many fans' addresses that are nobody's name."""
    mails = claimed.filter("field = 'email'").select("fan_id", "value").distinct()
    total = mails.agg(F.count_distinct("fan_id").alias("fans"))
    words = mails.select("fan_id", F.explode(_words(F.col("value"))).alias("word")).groupBy("word").agg(F.count_distinct("fan_id").alias("n"))
    often = words.join(F.broadcast(total)).filter(F.col("n") >= F.greatest(F.lit(3.0), COMMON_WORD * F.col("fans"))).select("word")  # total is one row
    return often.join(names.select(F.col("name").alias("word")), "word", "left_anti")


def plain_names(own: DataFrame) -> DataFrame:
    first, last = (F.regexp_replace(F.coalesce(spell_plain(c), F.lit("")), "[^a-z -]", "") for c in ("first_name", "last_name"))
    return own.select(F.explode(F.split(F.concat_ws(" ", first, last), "[ -]+")).alias("name")).distinct()


def claims(records: DataFrame, xref: DataFrame, cut: Cut) -> DataFrame:
    """A row per fan_id, field, value, system and day: n, rec_id, first, last and what is seen on the claim (form, tag, names)."""
    own = members(records, xref)
    plain = own.withColumn("lastp", F.regexp_replace(F.coalesce(spell_plain("last_name"), F.lit("")), r"-.*$|[^a-z\-]", "")).withColumn("firstp", F.regexp_replace(F.coalesce(spell_plain("first_name"), F.lit("")), "[^a-z]", ""))
    years = own.filter("source_system <> 'crm' and birth_year is not null").groupBy("fan_id").agg(F.collect_set("birth_year").alias("years"))  # years are few by their nature
    plain = plain.join(years, "fan_id", "left")
    email, phone, dob = _trim_lower(F.col("email")), F.nullif(F.regexp_replace("phone", "[^0-9]", ""), F.lit("")), F.col("dob")
    local = F.split_part(email, F.lit("@"), F.lit(1))
    year_known, year_same = F.col("years").isNotNull().cast("int"), F.coalesce(F.array_contains("years", F.year(dob)), F.lit(False)).cast("int")
    holds = lambda k: ((F.length(k) > 2) & F.contains(local, F.col(k))).cast("int")
    day_ok = (dob >= F.lit("1915-01-01").cast("date")) & (dob < F.col("observed_at").cast("date"))
    none = F.lit(0)
    each = F.array(
        F.struct(F.lit("email").alias("field"), email.alias("value"), email.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$").alias("form"), F.contains(local, F.lit("+")).alias("tag"), holds("lastp").alias("has_last"), holds("firstp").alias("has_first")),
        F.struct(F.lit("phone").alias("field"), F.right(phone, F.lit(10)).alias("value"), F.length(phone).between(10, 13).alias("form"), F.lit(False).alias("tag"), none.alias("has_last"), none.alias("has_first")),
        F.struct(F.lit("dob").alias("field"), dob.cast("string").alias("value"), day_ok.alias("form"), F.lit(False).alias("tag"), year_known.alias("has_last"), year_same.alias("has_first")),
    )
    day = F.coalesce(F.unix_date(F.col("observed_at").cast("date")), F.lit(NO_DAY)).alias("day")
    rows = plain.select("fan_id", "rec_id", F.col("source_system").alias("system"), F.col("observed_at").alias("at"), day, F.inline(each)).filter("value is not null")
    has = F.lit(False)
    for field, systems in SYSTEMS.items():
        has = has | ((F.col("field") == field) & F.col("system").isin(*systems))
    sums = [F.count("*").alias("n"), F.min("rec_id").alias("rec_id"), F.min("at").alias("first"), F.max("at").alias("last"), F.bool_and(F.coalesce("form", F.lit(False))).alias("form"), F.bool_or("tag").alias("tag")]
    return cut.table(rows.filter(has).groupBy("fan_id", "field", "value", "system", "day").agg(*sums, F.max("has_last").alias("has_last"), F.max("has_first").alias("has_first")))


def _slip_keys(v: Column, field: Column) -> Column:
    """Keys that a value shares with another one letter, or two swapped letters, away."""
    local = F.split_part(v, F.lit("@"), F.lit(1))
    plus = F.regexp_replace(local, r"\+.*$", "")
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    mail = F.array(F.concat(F.lit("s:"), letters(F.regexp_replace(v, r"\+[^@]*@", "@"))), F.concat(F.lit("l:"), plus), F.concat(F.lit("b:"), F.left(plus, F.lit(5))), F.concat(F.lit("e:"), F.right(plus, F.lit(5))))
    other = F.array(F.concat(F.lit("s:"), letters(v)), F.concat(F.lit("b:"), F.left(v, F.lit(5))), F.concat(F.lit("e:"), F.right(v, F.lit(5))))
    return F.when(field == "email", mail).otherwise(other)


def _base(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(v, r"\+[^@]*@", "@"), r"@+|\s+at\s+", "@")


def value_kinds(claimed: DataFrame, names: DataFrame, cut: Cut) -> DataFrame:
    """fan_id, field, value with its kind, and `head`, the better supported value of the group that it is a slip or a variant of (else itself)."""
    g = ["fan_id", "field"]
    cand = claimed.groupBy(*g, "value").agg(
        F.bool_and("form").alias("form"), F.bool_or("tag").alias("tag"), F.sum("n").alias("n"), F.count_distinct("system").alias("s"), F.max("last").alias("last"), F.max("has_last").alias("has_last"), F.max("has_first").alias("has_first")
    )
    fans = cand.groupBy("field").agg(F.count_distinct("fan_id").alias("fans"))  # a row per field
    given = cand.groupBy("field", "value").agg(F.count("*").alias("k")).join(F.broadcast(fans), "field")
    popular = (F.col("k") >= POPULAR * F.col("fans")) & (F.col("k") > 2)
    given = given.select("field", "value", F.when(popular, "popular").when((F.col("k") > 1) & (F.col("field") != "dob"), "shared").alias("given")).filter("given is not null")
    worded = cand.filter("field = 'email'").select("value", F.explode(_words(F.col("value"))).alias("word")).distinct().join(common_words(claimed, names), "word").select("value", F.lit("email").alias("field"), F.lit(True).alias("worded")).distinct()
    domain = F.regexp_extract("value", r"@([^@]+)$", 1)
    near = near_domains(claimed.filter("field = 'email'").select(domain.alias("domain")).filter("domain <> ''"))
    cand = cand.withColumn("domain", F.when(F.col("field") == "email", domain))
    cand = cut.table(cand.join(given, ["field", "value"], "left").join(worded, ["field", "value"], "left").join(near, "domain", "left"))
    support = cand.groupBy(*g, _base(F.col("value")).alias("base")).agg(F.sum("n").alias("of_base"))  # a+shop@b and a@@b speak for a@b
    cand = cand.drop("n").withColumn("base", _base(F.col("value"))).join(support.withColumnRenamed("of_base", "n"), [*g, "base"])
    clean = F.col("form") & ~F.col("tag") & F.col("near").isNull()
    rank = F.struct(clean.alias("clean"), "n", (2 * F.col("has_last") + F.col("has_first")).alias("named"), "s", "last", "value")
    keyed = cand.select(*g, "value", rank.alias("rank"), F.explode(F.array_distinct(_slip_keys(F.col("value"), F.col("field")))).alias("key"))
    best = keyed.groupBy(*g, "key").agg(F.max("rank").alias("best"))
    a, b = _base(F.col("value")), _base(F.col("best.value"))
    close = (F.levenshtein(a, b, 2) >= 0) | (F.col("field") == "email") & (F.split_part(a, F.lit("@"), F.lit(1)) == F.split_part(b, F.lit("@"), F.lit(1)))
    met = keyed.join(best, [*g, "key"]).filter((F.col("best") > F.col("rank")) & close)
    head = met.groupBy(*g, "value").agg(F.max("best")["value"].alias("head"))
    out = cand.join(head, [*g, "value"], "left")
    kind = F.concat(
        F.when(F.col("given") == "popular", "popular").when(~F.col("form"), "form").when(F.col("tag"), "tag").when(F.col("near").isNotNull(), "near").when(F.col("head").isNotNull(), "slip").when(F.col("worded"), "word").otherwise(F.coalesce("given", F.lit("plain"))),
        F.when(~F.col("form") & F.col("head").isNotNull(), ":slip").otherwise(""),
        F.when(F.col("field") != "phone", F.concat(F.lit(":"), F.col("has_last"), F.col("has_first"))).otherwise(""),
    )
    return out.select(*g, "value", F.coalesce("head", "value").alias("head"), kind.alias("kind"))


def observed_claims(claimed: DataFrame, names: DataFrame, cut: Cut) -> DataFrame:
    """One row per group, field and value: kind, the system that brought it up, first and last sight, rec_id, and by system the records for it after the first (p_) and against it (q_)."""
    g = ["fan_id", "field"]
    kinds = cut.table(value_kinds(claimed, names, cut))
    spoken = claimed.join(kinds.select(*g, "value", "head"), [*g, "value"])
    # a record speaks for its value and for the value that this is a variant of
    votes = F.array_distinct(F.array("value", "head"))
    each = spoken.select(*g, "system", "day", "n", "first", "last", "rec_id", F.col("value").alias("said"), F.explode(votes).alias("value"))
    by_day = each.groupBy(*g, "value", "day").agg(
        *[F.sum(F.when(F.col("system") == s, F.col("n")).otherwise(0)).alias(f"p_{s}") for s in ALL_SYSTEMS], F.min("first").alias("first"), F.max("last").alias("last"), F.min(F.when(F.col("said") == F.col("value"), F.col("rec_id"))).alias("rec_id")
    )
    own = by_day.groupBy(*g, "value").agg(
        *[F.sum(f"p_{s}").alias(f"p_{s}") for s in ALL_SYSTEMS], F.min_by(F.struct(*[f"p_{s}" for s in ALL_SYSTEMS]), "day").alias("at_first"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("rec_id").alias("rec_id"),
    )
    own = cut.table(own.join(kinds, [*g, "value"]))
    births = own.filter("value = head").groupBy(*g, F.col("first_day").alias("day")).agg(F.lit(True).alias("birth"))
    days = claimed.groupBy(*g, "day").agg(*[F.sum(F.when(F.col("system") == s, F.col("n")).otherwise(0)).alias(f"d_{s}") for s in ALL_SYSTEMS]).join(births, [*g, "day"], "left")
    upto = Window.partitionBy(*g).orderBy("day")  # at most a row per day
    after = upto.rowsBetween(1, Window.unboundedFollowing)
    days = days.select(*g, "day", *[F.sum(f"d_{s}").over(upto).alias(f"c_{s}") for s in ALL_SYSTEMS], *[F.sum(f"d_{s}").over(Window.partitionBy(*g)).alias(f"t_{s}") for s in ALL_SYSTEMS], F.min(F.when(F.col("birth"), F.col("day"))).over(after).alias("next_birth"))
    days = days.withColumn("before_next", F.struct(*[F.max(F.col(f"c_{s}")).over(Window.partitionBy(*g, F.coalesce("next_birth", F.lit(10**7)))).alias(s) for s in ALL_SYSTEMS]))  # all that came before the next value began
    days = cut.table(days)
    start = days.select(*g, F.col("day").alias("first_day"), F.struct(*[f"c_{s}" for s in ALL_SYSTEMS]).alias("at_start"), F.struct(*[f"t_{s}" for s in ALL_SYSTEMS]).alias("all"), "before_next")
    end = days.select(*g, F.col("day").alias("last_day"), F.struct(*[f"c_{s}" for s in ALL_SYSTEMS]).alias("at_end"))
    met = own.join(start, [*g, "first_day"]).join(end, [*g, "last_day"])
    against = lambda s: F.when(F.col("field") == "dob", F.col(f"all.t_{s}") - F.col(f"p_{s}")).otherwise(
        F.greatest(F.lit(0), F.greatest(F.col(f"at_end.c_{s}"), F.col(f"before_next.{s}")) - F.col(f"at_start.c_{s}") - (F.col(f"p_{s}") - F.col(f"at_first.p_{s}")))
    )
    brought = F.coalesce(*[F.when(F.col(f"at_first.p_{s}") > 0, F.lit(s)) for s in ALL_SYSTEMS])
    support = [(F.col(f"p_{s}") - (brought == s).cast("int")).alias(f"p_{s}") for s in ALL_SYSTEMS]
    return met.select(*g, "value", "kind", brought.alias("by"), "first", "last", "rec_id", *support, *[against(s).alias(f"q_{s}") for s in ALL_SYSTEMS])


def _logit(x: float) -> float:
    return math.log(x / (1 - x))


class Quality:
    """Sensitivity and specificity by field and system, and the share of true claims by field, kind and system that brought them up."""

    def __init__(self, kinds: list[tuple[str, str, str]]) -> None:
        self.sens = {(f, s): 0.8 for f, ss in SYSTEMS.items() for s in ss}
        self.spec = {(f, s): 0.7 for f, ss in SYSTEMS.items() for s in ss}
        self.true = {k: 0.5 for k in kinds}

    def posterior(self, single: str | None = None) -> Column:
        """The probability that a claim is true, for rows with field, kind, by, and p_ and q_ of each system.

        Of a field that holds a single true value (`single`) the claims exclude each other; there the odds against none of
        them being true are those of the claim's own support.
        """
        key = F.concat_ws("|", "field", "kind", "by")
        shares = [x for (f, k, s), t in sorted(self.true.items()) for x in (F.lit(f"{f}|{k}|{s}"), F.lit(_logit(t)))]
        prior = F.try_element_at(F.create_map(*shares), key) if shares else F.lit(0.0)
        out = F.lit(0.0)
        for f, ss in SYSTEMS.items():
            z = prior
            for s in ss:
                sens, spec = self.sens[f, s], self.spec[f, s]
                z = z + F.col(f"p_{s}") * math.log(sens / (1 - spec))
                if f != single:
                    z = z + F.col(f"q_{s}") * math.log((1 - sens) / spec)
            out = F.when(F.col("field") == f, z).otherwise(out)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), out))))

    def round(self, rows: list) -> float:
        """Sets all parameters from one row of sums per field, kind and system that brought the claims up; the largest move."""
        was = self.values()
        kinds: dict[tuple[str, str], list[float]] = {}
        for r in rows:
            k = kinds.setdefault((r["field"], r["kind"]), [1.0, 2.0])
            k[0], k[1] = k[0] + r["t"], k[1] + r["n"]
        for r in rows:  # few claims of one system lean on the share of their kind
            t, n = kinds[r["field"], r["kind"]]
            self.true[r["field"], r["kind"], r["by"]] = (r["t"] + 2 * t / n) / (r["n"] + 2)
        for f, s in self.sens:
            a, b, c, d = (sum(r[f"{k}_{s}"] for r in rows if r["field"] == f) for k in ("t_p", "t_q", "f_p", "f_q"))
            self.sens[f, s], self.spec[f, s] = (a + 1) / (a + b + 2), (d + 1) / (c + d + 2)
        return max((abs(x - y) for x, y in zip(self.values(), was)), default=0.0)

    def leap(self, before: list[float], last: list[float]) -> None:
        """Moves each parameter to where its last two steps, shrinking as they do, would end."""
        for x in (self.sens, self.spec, self.true):
            for i, k in enumerate(x, {id(self.sens): 0, id(self.spec): len(self.sens)}.get(id(x), 2 * len(self.sens))):
                d1, d2 = _logit(last[i]) - _logit(before[i]), _logit(x[k]) - _logit(last[i])
                r = d2 / d1 if abs(d1) > 1e-9 else 0.0
                if 0 < r < 1:
                    z = _logit(x[k]) + d2 * min(r, 0.9) / (1 - min(r, 0.9))
                    x[k] = 1 / (1 + math.exp(-max(-12.0, min(12.0, z))))

    def values(self) -> list[float]:
        return [*self.sens.values(), *self.spec.values(), *self.true.values()]


def fit_quality(obs: DataFrame, cut: Cut) -> Quality:
    """Expectation-maximisation over all claims. They are counted by what is seen on them once, and a round is one
    aggregate of these counts to a row per field, kind and system; nothing else leaves the cluster. Every fourth round
    leaps ahead; only a plain round that moves nothing ends the fit."""
    seen = [f"{c}_{s}" for c in "pq" for s in ALL_SYSTEMS]
    counts = cut.table(obs.groupBy("field", "kind", "by", *seen).agg(F.count("*").alias("n")))
    q = Quality([(r["field"], r["kind"], r["by"]) for r in counts.select("field", "kind", "by").distinct().collect()])  # kinds and systems are few by their nature
    track: list[list[float]] = []
    for _ in range(MAX_ROUNDS):
        w = counts.withColumn("post", q.posterior())
        sums = [F.sum(F.col("n") * t * F.col(c)).alias(f"{k}_{c}") for c in seen for k, t in (("t", F.col("post")), ("f", 1 - F.col("post")))]
        track.append(q.values())
        if q.round(w.groupBy("field", "kind", "by").agg(F.sum(F.col("n") * F.col("post")).alias("t"), F.sum("n").alias("n"), *sums).collect()) < SETTLED:
            cut.drop(counts)
            return q
        if len(track) == 4:
            q.leap(track[-2], track[-1])
            track = []
    raise RuntimeError("the quality model did not settle")


def true_values(records: DataFrame, xref: DataFrame, cut: Cut) -> DataFrame:
    """Every value judged true: fan_id, field_name, value, rec_id, first, last, probability."""
    obs = cut.table(observed_claims(claims(records, xref, cut), plain_names(members(records, xref)), cut))
    post = fit_quality(obs, cut).posterior(single="dob")
    possible = ~F.startswith(F.col("kind"), F.lit("form"))  # what has no valid form speaks for the value it is a slip of, and is never chosen
    kept = obs.withColumn("probability", post).filter((F.col("probability") >= 0.5) & F.col("rec_id").isNotNull() & possible)
    return kept.select("fan_id", F.col("field").alias("field_name"), "value", "rec_id", "first", "last", "probability")


def golden_values(records: DataFrame, xref: DataFrame, cut: Cut) -> DataFrame:
    """The value of each fan and field that is right today: of those judged true the one that began last; of dates of birth the likeliest."""
    return _newest(true_values(records, xref, cut))


def _newest(t: DataFrame) -> DataFrame:
    started = F.coalesce(F.unix_micros(F.col("first").cast("timestamp")), F.lit(-(1 << 62))).cast("double")
    rank = F.struct(F.when(F.col("field_name") == "dob", F.col("probability")).otherwise(started).alias("a"), F.col("last").alias("b"), F.col("value").alias("c"))
    return t.groupBy("fan_id", "field_name").agg(F.max_by(F.struct("value", "rec_id", "probability"), rank).alias("g")).select("fan_id", "field_name", F.col("g.value").alias("value"), F.col("g.rec_id").alias("rec_id"), F.col("g.probability").alias("probability"))


def golden_fans(records: DataFrame, xref: DataFrame, cut: Cut) -> DataFrame:
    """One row per fan: email, phone and dob of today, all e-mail addresses judged true, sources and record count."""
    t = cut.table(true_values(records, xref, cut))
    best = _newest(t).groupBy("fan_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in SYSTEMS])
    mails = t.filter("field_name = 'email'").groupBy("fan_id").agg(F.array_sort(F.collect_set("value")).alias("emails"))
    own = members(records, xref).groupBy("fan_id").agg(F.array_join(F.array_sort(F.collect_set("source_system")), ",").alias("sources"), F.count("*").alias("record_count"))
    return own.join(best, "fan_id", "left").join(mails, "fan_id", "left").withColumn("emails", F.array_join("emails", ",")).withColumn("dob", F.col("dob").cast("date"))
