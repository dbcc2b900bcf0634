"""Fixed lookup values. They must stay exactly as listed for equal results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw company status -> canonical flag (exact, case-sensitive).
STATUS_FLAGS: dict[str, tuple[str, ...]] = {
    "active": (
        "active", "Active", "ACTIVE", "open", "Open", "operating", "Operating",
        "Actively Seeking New Employees", "Will Consider New Projects",
        "Acquired/Merged (Operating Subsidiary)",
    ),
    "inactive": (
        "inactive", "Inactive", "INACTIVE", "dormant", "Dormant", "paused", "Paused",
        "Not Making New Products", "Reducing Activity", "Acquired/Merged",
    ),
    "suspended": ("suspended", "Suspended", "SUSPENDED", "on hold", "On Hold", "frozen"),
    "closed": (
        "closed", "Closed", "CLOSED", "dissolved", "Dissolved", "liquidated", "Liquidated",
        "bankrupt", "Bankrupt", "terminated", "Terminated", "Out of Business",
    ),
}

# Business type -> risk tier (exact, case-sensitive).
RISK_TIERS: dict[str, tuple[str, ...]] = {
    "low": (
        "Retail", "retail", "Grocery", "grocery", "Supermarket", "supermarket", "Food", "food",
        "Restaurant", "restaurant", "Cafe", "cafe", "Healthcare", "healthcare", "Pharmacy", "pharmacy",
        "Education", "education", "Professional Services", "professional_services", "Law",
        "Accounting", "accounting", "Logistics", "logistics", "Transportation", "transportation",
        "Manufacturing", "manufacturing", "Agriculture", "agriculture", "Utilities", "utilities",
        "Office", "Gardening",
    ),
    "medium": (
        "Technology", "technology", "Tech", "tech", "Software", "software", "E-commerce", "ecommerce",
        "e-commerce", "Online Retail", "online_retail", "Media", "media", "Marketing", "marketing",
        "Consulting", "consulting", "Real Estate", "real_estate", "Construction", "construction",
        "Import/Export", "import_export", "Wholesale", "wholesale", "Events", "events",
        "Entertainment", "entertainment", "Hospitality", "hospitality", "Travel", "travel",
        "Fitness", "fitness", "Beauty", "beauty", "Pets", "Toys", "Sport", "Furniture", "Electronics",
        "Pharma", "Banking", "Family Office", "VC-Backed Company", "Growth/Expansion",
        "Limited Partner", "Impact Investing", "Holding Company", "Lender/Debt Provider", "Other",
    ),
    "high": (
        "Alcohol", "Angel (individual)", "Angel Group", "Startup", "startup", "Crypto", "crypto",
        "Cryptocurrency", "cryptocurrency", "NFT", "nft", "Gambling", "gambling", "Gaming", "gaming",
        "Nightclub", "nightclub", "Bar", "bar", "Speculative", "speculative", "Mining", "mining",
        "Cannabis", "cannabis", "Firearms", "firearms",
    ),
}

# Portfolio feature -> (label, description, unit hint).
GLOSSARY: dict[str, tuple[str, str, str]] = {
    "LandlordAge": (
        "Landlord age (years)",
        "How long the landlord has been operating (years since founding).",
        "years",
    ),
    "Area": (
        "Property / campus area",
        "Physical area associated with the landlord.",
        "area units",
    ),
    "TotalPopulationAround": (
        "Nearby population",
        "Population living around the landlord’s location.",
        "people",
    ),
    "ActiveCompanies": (
        "Reported active companies",
        "Number of companies the landlord reports as active tenants.",
        "companies",
    ),
    "PopulationDensity": (
        "Population density",
        "Nearby population divided by area (crowding / urban intensity).",
        "people per area",
    ),
    "AreaPerCompany": (
        "Area per company",
        "Space available per reported company (area ÷ active companies).",
        "area per company",
    ),
    "PopulationPerCompany": (
        "Population per company",
        "Nearby population per reported company.",
        "people per company",
    ),
    "PreferredIndustry": (
        "Preferred industry",
        "Industry focus the landlord prefers for tenants.",
        "category",
    ),
    "OriginCity": (
        "Origin city",
        "City associated with the landlord’s origin / base.",
        "city",
    ),
    "OriginCountry": (
        "Origin country",
        "Country associated with the landlord’s origin / base.",
        "country",
    ),
    "PortfolioSize": (
        "Matched tenant count",
        "How many tenant companies were matched for this landlord in the data.",
        "tenants",
    ),
    "PortfolioActiveRate": (
        "Share of active tenants",
        "Fraction of matched tenants labelled as currently active / seeking work.",
        "share (0–1)",
    ),
    "PortfolioMeanBudget": (
        "Average tenant monthly budget",
        "Mean monthly budget across the landlord’s matched tenant companies.",
        "currency units / month",
    ),
    "PortfolioStdBudget": (
        "Budget variation across tenants",
        "How much tenant monthly budgets vary (standard deviation).",
        "currency units",
    ),
    "PortfolioMeanSales": (
        "Average tenant sales intensity",
        "Mean sales-of-main-product signal across tenant companies.",
        "sales index",
    ),
    "PortfolioMeanClients": (
        "Average tenant client base",
        "Mean number of active clients that tenant companies report.",
        "clients",
    ),
    "PortfolioMeanRetention": (
        "Average tenant client retention",
        "Mean share of returning clients among tenants (loyalty / stickiness).",
        "share (0–1)",
    ),
    "PortfolioMeanSuccessScore": (
        "Average tenant success score",
        "Mean composite company-success score across the tenant portfolio.",
        "score (0–1)",
    ),
    "PortfolioStdSuccessScore": (
        "Success-score variation across tenants",
        "How much tenant success scores vary within the portfolio.",
        "score units",
    ),
}

# Short names used in the briefing bullets.
SHORT_LABELS: dict[str, str] = {
    "PortfolioMeanClients": "Tenant client base",
    "PortfolioMeanBudget": "Tenant monthly budget",
    "PortfolioMeanSales": "Tenant sales intensity",
    "PortfolioMeanRetention": "Tenant client retention",
    "PortfolioActiveRate": "Share of active tenants",
    "PortfolioMeanSuccessScore": "Average tenant success score",
    "PortfolioStdSuccessScore": "Success-score variation",
    "PortfolioStdBudget": "Budget variation across tenants",
    "PortfolioSize": "Matched tenant count",
    "ActiveCompanies": "Reported active companies",
    "LandlordAge": "Landlord age",
    "Area": "Property area",
    "TotalPopulationAround": "Nearby population",
    "PopulationDensity": "Population density",
    "AreaPerCompany": "Area per company",
    "PopulationPerCompany": "Population per company",
    "PreferredIndustry": "Preferred industry",
    "OriginCity": "Origin city",
    "OriginCountry": "Origin country",
}

# Churn feature -> phrase shown to an analyst.
CHURN_NAMES: dict[str, str] = {
    "recency_days": "days since last invoice",
    "tenure_days": "customer tenure",
    "n_events": "number of billing events",
    "n_events_past12": "billing events in the last 12 months",
    "total_amount": "lifetime revenue",
    "past12_amount": "revenue in the last 12 months",
    "prior12_amount": "revenue in the prior 12 months",
    "mean_amount": "average invoice amount",
    "last_amount": "most recent invoice amount",
    "max_amount": "largest invoice amount",
    "n_invoices_total": "total invoice lines",
    "revenue_trend": "revenue trend (recent vs prior year)",
    "amount_cv": "invoice-amount variability",
    "median_gap_days": "typical days between invoices",
    "gap_cv": "billing regularity",
    "n_gaps": "observed billing cycles",
    "interval_confidence": "billing-interval confidence",
    "dominant_share": "dominant-cadence share",
    "n_distinct_bases": "competing cadences",
    "is_insufficient_history": "flag: insufficient history",
    "is_one_time_candidate": "flag: likely one-time",
    "is_monthly": "flag: monthly cadence",
    "is_quarterly": "flag: quarterly cadence",
    "is_semi_annual": "flag: semi-annual cadence",
    "is_annual": "flag: annual cadence",
    "is_mixed": "flag: mixed cadence",
    "is_irregular": "flag: irregular cadence",
}

# Billing interval -> plain phrase.
INTERVAL_PHRASES: dict[str, str] = {
    "insufficient_history": "not enough invoice history yet to tell the billing cycle",
    "one_time_candidate": "looks like a one-time / non-recurring charge pattern",
    "monthly": "monthly billing (about every month)",
    "quarterly": "quarterly billing (about every 3 months)",
    "semi_annual": "semi-annual billing (about every 6 months)",
    "annual": "annual billing (about once a year)",
    "mixed": "mixed cadence (more than one regular billing pattern)",
    "irregular": "irregular / no clear calendar billing cycle",
}


def by_class(c: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """Class whose listed values hold the cell; null when none does. One hash-set test per class."""
    out = None
    for name, values in classes.items():
        out = F.when(c.isin(*values), F.lit(name)) if out is None else out.when(c.isin(*values), F.lit(name))
    return out


def by_name(c: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """Text listed for the cell, or the default."""
    out = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)
    return out if default is None else F.coalesce(out, default)
