"""Ratios and accounting scores of a filing, as expressions over the current and the previous filing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.scalar import clip, divide, ieee_divide


def _point(test: Column) -> Column:
    return F.when(test, 1).otherwise(0)


def f_score(q: Column, p: Column) -> Column:
    """Eight tests, one point each; an unknown comparison gives none. NULL without a previous filing."""
    held = q["assets"] > 0
    roa = F.when(held, q["ni"] / q["assets"])
    debt = F.when(held, q["liabilities"] / q["assets"])
    tests = [
        roa > 0,
        q["op_cash"] > 0,
        roa > ieee_divide(p["ni"], p["assets"]),
        q["op_cash"] > q["ni"],
        debt < ieee_divide(p["liabilities"], p["assets"]),
        ieee_divide(q["curr_assets"], q["curr_liab"]) > ieee_divide(p["curr_assets"], p["curr_liab"]),
        ieee_divide(q["gp"], q["rev"]) > ieee_divide(p["gp"], p["rev"]),
        ieee_divide(q["rev"], q["assets"]) > ieee_divide(p["rev"], p["assets"]),
    ]
    return F.when(p.isNotNull(), sum((_point(t) for t in tests[1:]), _point(tests[0])).cast("double"))


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def _index(test: Column, value: Column) -> Column:
    """A score's index, 1 where its guard doesn't hold, kept within [0.01, 10]."""
    return clip(F.when(test, value).otherwise(1.0), 0.01, 10.0)


def m_score(q: Column, p: Column) -> Column:
    """Seven clipped indices and accruals of zero, in the usual eight-variable weights; NULL where sales or assets are 0."""
    rec, p_rec, ppe, p_ppe = (_zero(x) for x in (q["receivables"], p["receivables"], q["ppe"], p["ppe"]))
    dep, p_dep, sga, p_sga = (_zero(x) for x in (q["dep_amort"], p["dep_amort"], q["sga"], p["sga"]))
    dsri = _index(p_rec > 0, divide(divide(rec, q["rev"]), divide(p_rec, p["rev"])))
    gmi = _index(q["rev"] - q["cogs"] > 0, divide(divide(p["rev"] - p["cogs"], p["rev"]), divide(q["rev"] - q["cogs"], q["rev"])))
    aqi = _index(p["assets"] > 0, divide(1 - divide(q["curr_assets"] + ppe, q["assets"]), 1 - divide(p["curr_assets"] + p_ppe, p["assets"])))
    sgi = clip(divide(q["rev"], p["rev"]), 0.01, 10.0)
    rate = F.when(ppe + dep > 0, divide(dep, ppe + dep)).otherwise(0.0)
    p_rate = F.when(p_ppe + p_dep > 0, divide(p_dep, p_ppe + p_dep)).otherwise(0.0)
    depi = _index(rate > 0, divide(p_rate, rate))
    sgai = _index(p_sga > 0, divide(divide(sga, q["rev"]), divide(p_sga, p["rev"])))
    lvgi = _index(p["liabilities"] > 0, divide(divide(q["liabilities"], q["assets"]), divide(p["liabilities"], p["assets"])))
    tata = F.when(q["ni"].isNotNull(), 0.0)
    # The published weights of the score.
    score = -4.84 + 0.920 * dsri + 0.528 * gmi + 0.404 * aqi + 0.892 * sgi + 0.115 * depi - 0.172 * sgai + 4.679 * tata - 0.327 * lvgi
    known = (q["rev"] != 0) & (p["rev"] != 0) & (q["assets"] != 0) & (p["assets"] != 0)
    return F.when(known, score)


def o_score(q: Column, p: Column) -> Column:
    """A probability of distress by the logistic function; NULL where assets aren't positive or the exponent overflows."""
    ta, tl, ca, cl, ni = q["assets"], q["liabilities"], q["curr_assets"], q["curr_liab"], q["ni"]
    change = F.abs(ni) + F.abs(p["ni"])
    # The published weights of the score.
    o = (
        -1.32
        - 0.407 * F.log(F.when(ta > 0, ta))
        + 6.03 * divide(tl, ta)
        - 1.43 * divide(ca - cl, ta)
        + 0.0757 * F.when(ca > 0, divide(cl, ca)).otherwise(0.0)
        - 1.72 * F.when(tl > ta, 1.0).otherwise(0.0)
        - 2.37 * divide(ni, ta)
        - 1.83 * F.when(tl > 0, divide(q["op_cash"], tl)).otherwise(0.0)
        + 0.285 * F.when((ni < 0) & (p["ni"] < 0), 1.0).otherwise(0.0)
        - 0.521 * F.when(change > 0, divide(ni - p["ni"], change)).otherwise(0.0)
    )
    return F.when(p.isNotNull() & (ta > 0) & (o <= 709.78), F.exp(o) / (1 + F.exp(o)))


def altman(curr_assets: str, curr_liab: str, ni: str, assets: str) -> Column:
    """The two-term form over trailing values."""
    return 1.2 * divide(F.col(curr_assets) - F.col(curr_liab), assets) + 1.4 * divide(ni, assets)


def ratios() -> dict[str, Column]:
    """The ratio features over trailing columns ``ttm_*``, ``mkt_cap``, and the single quarter's ``ebit`` and ``dep_amort``."""
    t = lambda c: F.col(f"ttm_{c}")
    return {
        "gross_margin": divide(t("gp"), t("rev")),
        "net_margin": divide(t("ni"), t("rev")),
        "roa": divide(t("ni"), t("assets")),
        "asset_turnover": divide(t("rev"), t("assets")),
        "current_ratio": divide(t("curr_assets"), t("curr_liab")),
        "debt_to_equity": divide(t("liabilities"), t("equity")),
        "fcf_yield": divide(t("fcf"), "mkt_cap"),
        "rd_intensity": divide(t("rnd"), t("rev")),
        "capex_to_sales": divide(t("capex"), t("rev")),
        "pe_ratio": divide("mkt_cap", t("ni")),
        "ps_ratio": divide("mkt_cap", t("rev")),
        "ev_ebitda": divide(F.col("mkt_cap") + t("liabilities"), F.col("ebit") + F.col("dep_amort")),
        "buyback_yield": divide(F.abs(t("repurchase")) + F.abs(t("div_paid")), "mkt_cap"),
    }
