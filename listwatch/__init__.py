"""Listing-watch analytics on Spark: DataFrame operators for matching listings to subscriptions, keeping listing state, alerts, runs and plan entitlements."""
