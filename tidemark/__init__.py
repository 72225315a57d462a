"""Event-sourced data as Spark DataFrames: journals, replay, command processing, subscriptions."""
