"""Word lists, code tables and patterns that results depend on."""

from __future__ import annotations

# Fixed values. Companies followed, by ticker.
COMPANIES = {
    "DLR": "Digital Realty Trust",
    "EQIX": "Equinix",
    "AMT": "American Tower",
    "MSFT": "Microsoft",
    "GOOGL": "Alphabet (Google)",
    "AMZN": "Amazon",
    "META": "Meta Platforms",
    "NVDA": "NVIDIA",
}

# Fixed values. Tickers of the one-shot panel.
PANEL_TICKERS = ["AMT", "AMZN", "CCI", "DLR", "EQIX", "GOOGL", "IRM", "META", "MSFT", "NVDA", "SBAC"]

# Fixed values. Promise ticker codes.
TICKER_PREFIX = "TICKER_"
TICKER_MAP = {
    "TICKER_MSFT": "MSFT",
    "TICKER_GOOGL": "GOOGL",
    "TICKER_AMZN": "AMZN",
    "TICKER_META": "META",
    "TICKER_NVDA": "NVDA",
    "TICKER_DLR": "DLR",
    "TICKER_EQIX": "EQIX",
    "TICKER_AMT": "AMT",
    "TICKER_PLD": "PLD",
}

# Fixed values. Grid regions with a queue column in the panel.
QUEUE_REGIONS = ["CAISO", "ERCOT", "MISO", "PJM", "SPP"]
GRID_REGIONS = ["ERCOT", "CAISO", "MISO", "PJM", "NYISO", "SPP"]

# Fixed values. Company tiers: lower bound of the market value in dollars.
TIERS = ["TIER_1", "TIER_2", "TIER_3", "TIER_4"]
TIER_BOUNDS = [(100e9, "TIER_1"), (10e9, "TIER_2"), (1e9, "TIER_3")]

# Fixed values. Filing sections and text patterns.
FILING_SECTIONS = ["business", "risk_factors", "management_discussion"]
POWER_PATTERN = r"\d[\d,]+\s*(?:MW|megawatt)"
DATA_CENTER_TERM = "data center"
AI_TERM = "artificial intelligence"
RENEWABLE_TERM = "renewable"
GLOBAL_KEYWORDS = [
    "europe", "asia", "latin america", "africa", "australia", "canada", "brazil", "singapore",
    "germany", "ireland", "netherlands", "united kingdom", "japan", "india",
]

# Fixed values. Jurisdictions that count as the United States, and state abbreviations.
STATE_ABBREVIATIONS = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA",
    "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC",
    "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL",
    "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA",
    "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN",
    "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV",
    "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY",
    "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR",
    "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD",
    "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA",
    "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
    "Puerto Rico": "PR",
}
US_JURISDICTIONS = [name for name in STATE_ABBREVIATIONS if name != "Puerto Rico"]

# Fixed values. Places and the (state, county) codes of their demographics.
PLACE_CODES = {
    "Phoenix, AZ": ("04", "013"), "San Antonio, TX": ("48", "029"), "West Des Moines, IA": ("19", "153"),
    "Mount Pleasant, WI": ("55", "101"), "Northern VA": ("51", "059"), "Portland, OR": ("41", "051"),
    "Houston, TX": ("48", "201"), "Alto, TX": ("48", "449"), "DeSoto County, FL": ("12", "031"),
    "Tompkins County, NY": ("36", "109"), "Columbus, OH": ("39", "049"), "Los Angeles, CA": ("06", "037"),
    "Chicago, IL": ("17", "031"), "Secaucus, NJ": ("34", "017"), "Dallas, TX": ("48", "113"),
    "Santa Clara, CA": ("06", "085"), "Ashburn, VA": ("51", "107"), "Denver, CO": ("08", "031"),
    "Seattle, WA": ("53", "033"), "Inland Empire, CA": ("06", "071"), "New York, NY": ("36", "061"),
    "San Diego, CA": ("06", "073"), "Austin, TX": ("48", "453"), "San Jose, CA": ("06", "085"),
    "Riverside, CA": ("06", "065"), "Atlanta, GA": ("13", "121"), "Monmouth County, NJ": ("34", "025"),
    "Las Vegas, NV": ("32", "003"),
}

# Fixed values. Columns of a demographic payload after its header row.
DEMOGRAPHIC_COUNTS = [
    "total_pop", "median_income", "housing_units", "median_home_value", "median_rent",
    "unemployed", "workers_16plus", "bachelors_degree", "doctorate",
]

# Fixed values. Column names of the price, ratio, macro and analyst tables.
RATIO_COLUMNS = [
    "market_cap", "enterprise_value", "revenue", "ebitda", "profit_margin", "operating_margin",
    "return_on_assets", "return_on_equity", "debt_to_equity", "current_ratio", "quick_ratio",
    "dividend_yield", "beta", "forward_pe", "trailing_pe", "price_to_book", "price_to_sales",
]
PROMISE_RATIOS = [
    "debt_to_equity", "current_ratio", "quick_ratio", "return_on_assets", "return_on_equity",
    "profit_margin",
]
MACRO_LAST = ["Real GDP", "Core CPI"]
MACRO_MEAN = ["Fed Funds Rate", "Unemployment Rate", "30Y Mortgage Rate", "10Y Treasury"]
DAILY_MACRO = ["Fed Funds Rate", "Unemployment Rate"]
RECOMMENDATIONS = ["strongBuy", "buy", "hold", "sell", "strongSell"]
TARGETS = {
    "current": "price_current",
    "high": "target_high",
    "low": "target_low",
    "mean": "target_mean",
    "median": "target_median",
}
