"""Explicit schemas of landed extracts and of the appended logs."""

# Landed campaign extracts, each platform with its own field names.
RAW_CAMPAIGNS = {
    "meta": "campaign_id string, id string, name string, objective string, status string, daily_budget double, "
            "lifetime_budget double, start_time string, stop_time string",
    "google": "campaign_id string, name string, status string, advertising_channel_type string, bidding_strategy_type string, "
              "budget_amount double, start_date string, end_date string",
    "tiktok": "campaign_id string, campaign_name string, objective_type string, status string, budget double, budget_mode string",
}

RAW_METRICS = {
    "meta": "campaign_id long, day date, impressions long, reach long, clicks long, spend double, "
            "actions array<struct<action_type string, value string>>, action_values array<struct<action_type string, value string>>, "
            "ctr double, cpc double, cpm double",
    "google": "campaign_id long, day date, impressions long, clicks long, cost_micros long, conversions double, conversions_value double, "
              "ctr double, average_cpc long, average_cpm long",
    "tiktok": "campaign_id long, day date, impressions long, reach long, clicks long, spend double, conversions long, ctr double, cpc double, cpm double",
}

ACCOUNTS = "account_id string, name string, currency string, timezone string, platform string"
AD_SETS = ("adset_id string, campaign_id string, name string, status string, "
           "targeting struct<age_min int, age_max int, countries array<string>>")
ADS = "ad_id string, adset_id string, name string, creative_id string, headlines array<string>, descriptions array<string>"
CREATIVES = "creative_id string, title string, body string, call_to_action string, creative_type string"
CUSTOMERS = "email string, purchase_value double, purchase_date date"

# Logs and tables written by the sinks.
PREDICTION_LOG = "model string, id string, features map<string,double>, prediction double, ts timestamp"
ACTUAL_LOG = "model string, id string, actual double, logged_at timestamp"
INTERACTIONS = "client_id long, interaction_type string, occurred_at timestamp, response_hours double, sentiment double"
METRICS = ("entity_type string, entity_id long, day date, impressions long, clicks long, conversions long, spend double, revenue double")
FEATURES = "entity_type string, entity_id string, feature string, value double"
