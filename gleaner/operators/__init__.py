"""Operators: DataFrame in, DataFrame out, by groups (an app and a storefront, unless named otherwise)."""

GROUP = ("app_id", "country")
