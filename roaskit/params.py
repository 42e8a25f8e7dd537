"""Fixed values of the analytics: weights, thresholds, lookup tables, names.

All of them are plain data that results depend on. Functions take them as
keyword defaults, so a caller can override any of them.
"""

# Forecast horizons: label -> days.
HORIZONS = {"30_days": 30, "60_days": 60, "90_days": 90}
MAX_HORIZON = 90

# Levels of the forecast, in report order.
OVERALL, CHANNEL, CAMPAIGN_TYPE, CAMPAIGN = "Overall", "Channel", "CampaignType", "Campaign"
LEVELS = (OVERALL, CHANNEL, CAMPAIGN_TYPE, CAMPAIGN)
PORTFOLIO = "Total Portfolio"

# Guard added to denominators of ratios.
EPS = 1e-5

# Recent-level anchor.
RECENT_ROWS = 30
MOMENTUM_ROWS = 60
SEASONAL_TRIGGER = 2.0
SLOPE_CAP = 0.03
DAMPING = 0.92
MODEL_WEIGHT_REVENUE = 0.08
MODEL_WEIGHT_SPEND = 0.25
MIN_SEASONAL_YEARS = 2

# Interval.
Z_80 = 1.28
HORIZON_POWER = 0.75
INTERVAL_SCALE = 1.0
P10_FLOOR = 0.05
DEFAULT_STD_OVERALL = 1000.0
DEFAULT_STD_ENTITY = 500.0

# Entities without a model.
MIN_MODEL_ROWS = 6
FALLBACK_SCALE = {CHANNEL: 0.33, CAMPAIGN_TYPE: 0.5, CAMPAIGN: 0.05}
TOP_DOWN_WEIGHT = 0.5
TOP_CAMPAIGNS = 10

# Members of the portfolio ensemble.
ENSEMBLE_WEIGHTS = {"seasonal": 0.35, "tree_a": 0.25, "tree_b": 0.20, "tree_c": 0.20}
YEARLY_TERM_MIN_DAYS = 365
YEARLY_PAIRS = 10
RIDGE = 1e-6
#: Members whose fit is a sum over days, so that SQL can solve the same equations.
LINEAR_MEMBERS = ("seasonal",)

# Backtest.
MIN_TRAIN_DAYS = 120
MIN_FOLD_DAYS = 14
TRAILING_DAYS = 30

# Spend response.
RESPONSE_BETA = {"Google Ads": 0.85, "Meta Ads": 0.82, "Bing Ads": 0.78}
DEFAULT_BETA = 0.80
UNKNOWN_ALPHA, UNKNOWN_BETA = 25.0, 0.82
DEFAULT_FIT_CV = 0.15
MAX_FIT_CV = 0.6
MIN_SIMULATED_SPEND = 100.0
DEFAULT_RUN_RATE = 25000.0
ALLOCATION_LOWER = 0.01
ALLOCATION_WIDE = 0.85
ALLOCATION_SMALL_SHARE = 0.10
ALLOCATION_STEPS = 200

# Risk weights: revenue volatility, channel dependency, roas instability, data quality.
RISK_WEIGHTS = (0.30, 0.25, 0.30, 0.15)

# Scenario table: id, name, tag, cpc change, conversion-rate change, revenue x, roas x.
SCENARIOS = (
    ("expected", "Expected Case (Baseline)", "Baseline", "0%", "0%", 1.0, 1.0),
    ("conservative", "Conservative Strategic Plan", "Low Risk", "+5%", "-8%", 0.88, 0.85),
    ("aggressive", "Aggressive Scale & Capture", "High Growth", "+15%", "+5%", 1.25, 1.08),
    ("recession", "Recessionary Slump", "Warning", "-10%", "-20%", 0.75, 0.80),
    ("holiday", "Q4 Holiday Season Multiplier", "Seasonal", "+25%", "+30%", 1.45, 1.16),
    ("black_friday", "Black Friday / Cyber Week Blitz", "Peak Event", "+50%", "+75%", 1.85, 1.25),
    ("high_competition", "Aggressive Competitor Bidding", "Threat", "+35%", "-10%", 0.90, 0.72),
)
SCENARIO_DEFAULTS = {"revenue": 250000.0, "roas": 4.5, "spend": 50000.0}

# Simulation.
HISTOGRAM_BINS = 25

# Imputed date of exports without a usable date.
DEFAULT_DATE = "2025-01-01"
DEFAULT_REVENUE_PER_CONVERSION = 50.0
