"""Explanations as column expressions: intervals, decisions, drivers, comparisons, briefings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions.lookups import CHURN_NAMES, GLOSSARY, INTERVAL_PHRASES, SHORT_LABELS, by_name

COUNT_LIKE = (
    "recency_days", "tenure_days", "median_gap_days", "n_events", "n_events_past12", "n_gaps",
    "n_invoices_total", "n_distinct_bases",
)
NOT_GIVEN = "not in input"


def say(*parts: Column | str) -> Column:
    """Concatenate; a null part makes the whole null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def fixed(c: Column, digits: int = 0) -> Column:
    """Fixed decimals, halves to even; null stays null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", F.bround(c.cast("double"), digits)))


def percent(c: Column, digits: int = 0) -> Column:
    return F.concat(fixed(c * 100.0, digits), F.lit("%"))


def signed_percent(c: Column) -> Column:
    return F.concat(F.format_string("%+.1f", F.bround(c * 100.0, 1)), F.lit("%"))


def interval_phrase(label: Column) -> Column:
    return by_name(label, INTERVAL_PHRASES, F.replace(label, F.lit("_"), F.lit(" ")))


def explain_interval(
    label: Column, confidence: Column, n_events: Column, n_gaps: Column, median_gap: Column, gap_cv: Column,
    dominant: Column, share: Column, n_bases: Column, recency: Column,
) -> Column:
    """Why this interval label: a template per label with gap, share, regularity and confidence."""
    plain = interval_phrase(label)
    start = say("We inferred **", plain, "**")
    days = lambda missing: F.coalesce(say(fixed(median_gap), " days"), F.lit(missing))
    whole_share = fixed(share * 100.0)
    thin = F.concat_ws(
        " ",
        F.when(
            n_events <= 1,
            say("because only ", n_events.cast("int"), " billing day(s) were observed before the assessment date — "
                "that is too little history to confirm a cycle"),
        ).otherwise(F.lit("because the recent history is still too short to confirm a stable cycle")),
        say("(last invoice about ", recency.cast("int"), " days before the snapshot)"),
    )
    once = F.lit(
        "because there is essentially a single invoice followed by a long quiet period with no repeat billing"
    )
    uneven = say(
        "because the gaps between invoices (typical gap ≈ ", days("unknown"),
        ") do not line up cleanly with monthly / quarterly / semi-annual / annual calendars",
    )
    mixed = F.concat_ws(
        " ",
        F.lit(
            "because invoice gaps cluster around more than one calendar period "
            "(for example a monthly subscription plus an annual fee)"
        ),
        say("— the strongest pattern is ", dominant, " (about ", whole_share, "% of matched gaps)"),
    )
    regular = F.concat_ws(
        " ",
        say("because the typical gap between billing days is about ", days("n/a"), ", which matches ", plain),
        F.when(n_gaps > 0, say("across ", n_gaps.cast("bigint"), " observed cycle(s)")),
        F.when(
            dominant.isNotNull(),
            say("(about ", whole_share, "% of gaps fit that pattern",
                F.when(n_bases > 1, say("; ", n_bases.cast("int"), " competing patterns seen")).otherwise(F.lit("")), ")"),
        ),
        F.when(
            gap_cv.isNotNull(),
            say("and spacing looks ",
                F.when(gap_cv < 0.2, F.lit("very regular")).when(gap_cv < 0.5, F.lit("fairly regular"))
                .otherwise(F.lit("somewhat uneven"))),
        ),
    )
    body = (
        F.when(label == "insufficient_history", thin).when(label == "one_time_candidate", once)
        .when(label == "irregular", uneven).when(label == "mixed", mixed).otherwise(regular)
    )
    return F.concat_ws(" ", start, body, say("Confidence in this label is **", percent(confidence), "**."))


def explain_decision(
    recommendation: Column, reason: Column, detail: Column, p: Column, confidence: Column, interval: Column,
    model_tag: str = "with interval features",
) -> Column:
    """Why Continue, Review or No-Go."""
    plain = by_name(interval, INTERVAL_PHRASES, F.coalesce(interval, F.lit("unknown cycle")))
    risk = F.when(p <= 0.3, F.lit("low")).when(p < 0.7, F.lit("elevated")).otherwise(F.lit("high"))
    base = say(
        f"Using the model **{model_tag}**, predicted chance of dollar churn is **", percent(p), "** (", risk, " risk)"
    )
    sure = say("interval confidence (", percent(confidence), ") is high enough to auto-decide, so the recommendation is ")
    return (
        F.when(
            reason == "no_history",
            F.lit("We recommended **Review** because there is no usable invoice history before the assessment date, "
                  "so the model cannot score this customer yet."),
        )
        .when(
            reason == "low_interval_confidence",
            say(f"We recommended **Review** ({model_tag}) because the billing-cycle signal is too uncertain (confidence ",
                percent(confidence), " for “", plain, "”). Thin or ambiguous history is treated as a data-quality issue — "
                "we do not auto Continue or auto No-Go until the cycle is clearer."),
        )
        .when(p.isNull(), say("We recommended **", recommendation, "**. ", F.coalesce(detail, F.lit(""))))
        .when(
            recommendation == "Continue",
            say(base, ". That sits below the Continue threshold, and ", sure, "**Continue** — proceed with onboarding."),
        )
        .when(
            recommendation == "No-Go",
            say(base, ". That sits above the No-Go threshold, and ", sure, "**No-Go** — decline or escalate for credit risk."),
        )
        .otherwise(say(
            base, ". That sits between the Continue and No-Go bands (or still needs analyst judgment), "
            "so the recommendation is **Review**."))
    )


def compare_decisions(with_rec: Column, without_rec: Column, p_with: Column, p_without: Column) -> Column:
    delta = signed_percent(p_with - p_without)
    return F.when(
        with_rec.eqNullSafe(without_rec),
        say("Both models agree on **", with_rec, "**. Adding the inferred interval changed churn probability by ",
            delta, " (with=", percent(p_with), ", without=", percent(p_without), ")."),
    ).otherwise(say(
        "The models **disagree**: with interval → **", with_rec, "**, without interval → **", without_rec,
        "**. Churn probability shifts from ", percent(p_without), " (no interval) to ", percent(p_with),
        " (with interval), Δ=", delta, ". This is exactly the decision-relevant value of the inferred cycle."))


def churn_value(feature: Column, value: Column) -> Column:
    """A churn feature's value as shown to an analyst."""
    return (
        F.when(feature.startswith("is_"), F.when(value >= 0.5, F.lit("yes")).otherwise(F.lit("no")))
        .when(value.isNull(), F.lit("n/a"))
        .when(feature.isin(*COUNT_LIKE), fixed(value))
        .otherwise(F.format_string("%,.2f", value))
    )


def explain_drivers(tier: Column, ups: Column, downs: Column, explained: Column) -> Column:
    """Top factors as sentences from arrays of (feature, contribution, value), strongest first."""
    label = lambda d: by_name(d["feature"], CHURN_NAMES, d["feature"])
    listed = lambda xs: F.array_join(
        F.transform(F.slice(xs, 1, 3), lambda d: say(label(d), " (value ", churn_value(d["feature"], d["value"]), ")")), "; "
    )
    first_up, first_down = F.get(ups, F.lit(0)), F.get(downs, F.lit(0))
    up_wins = F.coalesce(first_up["contribution"], F.lit(0.0)) >= F.coalesce(-first_down["contribution"], F.lit(0.0))
    main = F.when(up_wins, first_up["feature"]).otherwise(first_down["feature"])
    return F.when(
        ~explained,
        F.lit("Detailed factor-level explanation was not computed for this row "
              "(enable explain_top_n / select the customer to expand drivers)."),
    ).otherwise(F.concat_ws(
        " ",
        say("Overall risk tier: **", tier, "**."),
        say("The single biggest driver is **", by_name(main, CHURN_NAMES, main), "**, which is currently **",
            F.when(up_wins, F.lit("raising")).otherwise(F.lit("lowering")), "** churn risk."),
        F.when(F.size(ups) > 0, say("Factors pushing risk up: ", listed(ups), ".")),
        F.when(F.size(downs) > 0, say("Factors pulling risk down: ", listed(downs), ".")),
    ))


SHARE_LIKE = ("PortfolioActiveRate", "PortfolioMeanRetention", "PortfolioMeanSuccessScore")
WHOLE_LIKE = ("ActiveCompanies", "PortfolioSize", "PortfolioMeanClients", "LandlordAge", "TotalPopulationAround")
MONEY_LIKE = ("PortfolioMeanBudget", "PortfolioStdBudget", "Area", "AreaPerCompany")


def portfolio_value(feature: Column, value: Column) -> Column:
    """A portfolio feature's value (given as text) as shown in an explanation."""
    v = value.try_cast("double")
    big = F.abs(v) >= 1000
    whole = F.abs(v - F.rint(v)) < 1e-6
    money = F.when(big, F.format_string("%,.0f", F.bround(v, 0))).otherwise(F.format_string("%,.2f", v))
    number = (
        F.when(feature.isin(*SHARE_LIKE), F.when(v.between(0, 1), percent(v, 1)).otherwise(fixed(v, 2)))
        .when(
            feature.isin(*WHOLE_LIKE),
            F.when(whole, F.format_string("%,d", F.rint(v).cast("bigint"))).otherwise(F.format_string("%,.1f", v)))
        .when(feature.isin(*MONEY_LIKE) | big, money)
        .when(F.abs(v) >= 10, fixed(v, 2))
        .otherwise(F.round(v, 4).cast("string"))
    )
    return (
        F.when(value.isNull() | value.isin("__missing__", "nan", "NaN", "None", ""), F.lit(NOT_GIVEN))
        .when(v.isNull(), value)
        .when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(NOT_GIVEN))
        .otherwise(number)
    )


def enrich_driver(driver: Column) -> Column:
    """driver(feature, contribution, value text) with label, shown value, direction and a sentence."""
    feature, size = driver["feature"], F.abs(driver["contribution"])
    labels = {k: v[0] for k, v in GLOSSARY.items()}
    about = {k: v[1] for k, v in GLOSSARY.items()}
    label = by_name(feature, labels, F.replace(feature, F.lit("_"), F.lit(" ")))
    description = by_name(feature, about, say("Model feature `", feature, "`."))
    shown = portfolio_value(feature, driver["value"])
    way = F.when(driver["contribution"] > 0, F.lit("up")).otherwise(F.lit("down"))
    missing, tiny = shown == NOT_GIVEN, size < 0.001
    amount = F.format_string("%.4f", size)
    sentence = F.when(
        missing,
        say(label, " was not in the input. The model still applied its pattern for missing values, which moved "
            "this landlord's predicted score ", way, " by ", amount, " versus the typical baseline."),
    ).otherwise(say(
        "Because ", label, " was ", shown, ", the model moved this landlord's predicted score ", way, " by ", amount,
        " versus a typical landlord baseline."))
    note = F.when(tiny, F.lit(" (Very small contribution — practically negligible.)")).otherwise(F.lit(""))
    return F.struct(
        feature.alias("feature"), driver["contribution"].alias("contribution"), driver["value"].alias("value"),
        label.alias("label"), description.alias("description"), shown.alias("value_display"), way.alias("direction"),
        missing.alias("value_missing"), tiny.alias("negligible"),
        say(sentence, note, " ", description).alias("explanation"),
    )


def driver_phrase(d: Column) -> Column:
    """Compact phrase of an enriched driver."""
    shown = F.format_string("%+.4f", d["contribution"])
    return F.when(d["value_missing"], say(d["label"], " (not in input, ", shown, ")")).otherwise(
        say(d["label"], " was ", d["value_display"], " (", shown, ")")
    )


def _strength(size: Column) -> Column:
    return F.when(size >= 0.05, F.lit("strongly")).when(size >= 0.02, F.lit("clearly")).otherwise(F.lit("slightly"))


def _short(d: Column) -> Column:
    return by_name(d["feature"], SHORT_LABELS, d["label"])


def interpret_score(band: Column, confidence: Column, tenants: Column, ups: Column, downs: Column) -> Column:
    """struct(main_reason, positive_signals, negative_signals, final_interpretation) from enriched drivers."""
    size = lambda d: F.abs(d["contribution"])
    loud = lambda xs: F.filter(xs, lambda d: size(d) >= 0.001)
    plus = F.slice(F.transform(
        loud(ups), lambda d: say(_short(d), " ", _strength(size(d)), " improved the score.")), 1, 5)
    minus = F.transform(loud(downs), lambda d: F.when(
        d["value_missing"], say("Missing ", F.lower(_short(d)), " ", _strength(size(d)), " reduced the score.")
    ).otherwise(say(_short(d), " ", _strength(size(d)), " reduced the score.")))
    few = F.coalesce(tenants < 5, F.lit(False))
    low = F.coalesce(confidence == "low", F.lit(False))
    caveat = F.when(low, F.array(
        F.when(few, say("Small tenant count (", tenants.cast("bigint"), ") reduced confidence."))
        .otherwise(F.lit("Limited tenant information reduced confidence."))
    )).otherwise(F.array().cast("array<string>"))
    minus = F.slice(F.concat(minus, caveat), 1, 5)

    known = band.isin("good", "bad", "neutral")
    opening = F.when(known, say("The model classified this landlord as ", band)).otherwise(
        F.lit("The model scored this landlord"))
    up, down = F.get(ups, F.lit(0)), F.get(downs, F.lit(0))
    falls = F.coalesce(-down["contribution"], F.lit(0.0)) > F.coalesce(up["contribution"], F.lit(0.0))
    lead = F.when(falls, down).otherwise(up)
    gone = F.get(F.filter(downs, lambda d: d["value_missing"]), F.lit(0))
    main = (
        F.when((F.size(ups) == 0) & (F.size(downs) == 0), say(opening, ", but no strong feature drivers stood out."))
        .when(
            gone.isNotNull() & ((band == "bad") | (falls & (size(lead) >= 0.03))),
            say(opening, " mainly because important tenant-activity information was missing, especially ",
                F.lower(_short(gone)), "."),
        )
        .when(lead["value_missing"] & falls,
              say(opening, " mainly because ", F.lower(_short(lead)), " was missing from the available tenant signals."))
        .when(lead["value_missing"],
              say(opening, "; a missing-value pattern for ", F.lower(_short(lead)),
                  " still nudged the score upward, but other factors dominate."))
        .when(falls, say(opening, " mainly because ", F.lower(_short(lead)), " (", lead["value_display"], ") weighed the score down."))
        .otherwise(say(opening, " mainly because ", F.lower(_short(lead)), " (", lead["value_display"], ") supported a higher score."))
    )
    n_gone = F.size(F.filter(ups, lambda d: d["value_missing"])) + F.size(F.filter(downs, lambda d: d["value_missing"]))
    looks = (
        F.when(band == "bad", F.lit("appears weak based on available tenant signals"))
        .when(band == "good", F.lit("appears strong based on available tenant signals"))
        .when(band == "neutral", F.lit("looks mid-range based on available tenant signals"))
        .otherwise(F.lit("has a mixed score based on available signals"))
    )
    reasons = F.concat_ws(
        " and ",
        F.when(low | few, F.coalesce(
            say("only ", tenants.cast("bigint"), " matched tenant(s)"), F.lit("limited tenant coverage"))),
        F.when(n_gone > 0, F.lit("incomplete tenant information")),
    )
    weak = confidence.isin("low", "n/a") | confidence.isNull() | few | (n_gone >= 2)
    tail = (
        F.when(weak & (reasons != ""), say("but the confidence is low because the model has ", reasons))
        .when(weak, F.lit("but confidence is limited"))
        .when(confidence == "medium", F.lit("with moderate confidence from the tenant sample size"))
        .when(confidence == "high", F.lit("with relatively high confidence from the tenant sample size"))
    )
    final = say(F.concat_ws(", ", say("This landlord ", looks), tail), ".")
    return F.struct(
        main.alias("main_reason"), plus.alias("positive_signals"), minus.alias("negative_signals"),
        final.alias("final_interpretation"),
    )


def case_narrative(
    owner: Column, band: Column, score: Column, pred: Column, tenants: Column, ups: Column, downs: Column
) -> Column:
    """Paragraph for a case study from enriched drivers."""
    top = lambda xs, none: F.when(
        F.size(xs) > 0, F.array_join(F.transform(F.slice(xs, 1, 3), driver_phrase), "; ")).otherwise(F.lit(none))
    basis = F.coalesce(say("based on ", tenants.cast("bigint"), " matched tenants"), F.lit("tenant count unavailable"))
    predicted = F.coalesce(say(", and the model predicted ", F.format_string("%.4f", pred)), F.lit(""))
    predicted = F.when(pred.isNull(), F.lit("")).otherwise(predicted)
    return say(
        "Landlord `", owner, "` is a **", band, "** case with historical AdjustedScore ", F.format_string("%.4f", score),
        predicted, " (", basis, "). What pushed the score up: ", top(ups, "no strong upward drivers"),
        ". What pulled the score down: ", top(downs, "no strong downward drivers"),
        ". These are model associations used to explain the prediction — "
        "not proof that the landlord caused those tenant outcomes.")
