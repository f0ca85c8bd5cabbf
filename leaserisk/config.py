"""Fixed values and default parameters.

Every operator takes ``as_of`` explicitly; ``AS_OF`` is only the default
used by the registered queries (the clock is never read).
"""

import datetime as _dt

AS_OF = _dt.date(1999, 1, 1)
AS_OF_STR = AS_OF.isoformat()

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# ---------------------------------------------------------------------------
# Risk level thresholds on the integer risk score (HIGH >= 80, MEDIUM >= 50).
HIGH_THRESHOLD = 80
MEDIUM_THRESHOLD = 50
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH"]
# Cost constants used by measures and ROI.
TURNOVER_COST = 4000
CAMPAIGN_COST = 200
# Renewal window in days.
RENEWAL_WINDOW_DAYS = 90
# Allowed values.
LEASE_STATUSES = ["active", "expired", "terminated", "renewed"]
RENEWAL_STATUSES = ["active", "pending-renewal", "renewed", "not-renewed", "expired"]
ACTION_TYPES = ["email-campaign", "phone-call", "incentive-offer",
                "property-manager-visit", "rent-adjustment"]
ACTION_STATUSES = ["pending", "completed", "failed"]
EMPLOYMENT_STATUSES = ["employed", "self-employed", "unemployed", "retired", "student"]
PAYMENT_METHODS = ["ach", "credit-card", "debit-card", "check", "cash"]
TENANT_STATUSES = ["active", "inactive", "former", "prospective"]
# Tier edges of the BI view (integer style).
EXPIRY_TIERS = [30, 60, 90, 120]
SCORE_TIERS = [20, 40, 60, 80]
TENURE_TIERS = [6, 12, 24, 36, 60]
RENT_TIERS = [1500, 2000, 2500, 3000, 4000]
# Rule-based churn score, in integer hundredths of probability.
RULE_BASE = 30
RULE_NO_AUTOPAY = 10
RULE_COMPLAINTS = 15          # complaint_count > 1
RULE_POOR_CONDITION = 10      # condition_rating < 3
RULE_OLD_PROPERTY = 5         # property_age > 40
RULE_RENT_ABOVE_MARKET = 15   # rent / market > 1.1
RULE_RENT_BELOW_MARKET = -10  # rent / market < 0.9
RULE_LONG_TENURE = -10        # tenure months (days / 30) > 24
RULE_SHORT_TENURE = 10        # tenure months < 6
RULE_HIGH_VACANCY = -5        # vacancy rate > 0.07
# Incentive offer rules: score >= 70 -> 5% of rent rent-discount,
# score >= 60 -> 500 upgrade, else 250 gift-card; expires after 30 days.
INCENTIVE_DISCOUNT_SCORE = 70
INCENTIVE_UPGRADE_SCORE = 60
INCENTIVE_DISCOUNT_RATE = 0.05
INCENTIVE_UPGRADE_VALUE = 500
INCENTIVE_GIFT_VALUE = 250
INCENTIVE_EXPIRY_DAYS = 30
# Workflow metadata: mitigation value = risk score * 40.
MITIGATION_PER_POINT = 40
# Business impact (README figures): 35% preventable, 3000 saved each.
PREVENTABLE_SHARE = 0.35
SAVING_PER_PREVENTED = 3000

# ---------------------------------------------------------------------------
# Our own rules (no counterpart in the reference; no parity claimed).
# ---------------------------------------------------------------------------
INCOME_BRACKETS = [50000, 75000, 100000, 125000]
PAYMENT_TREND_DELTA = 1.0
ENGAGEMENT_HIGH_THRESHOLD = 3
FISCAL_YEAR_START_MONTH = 7
DATA_RETENTION_MONTHS = 84
