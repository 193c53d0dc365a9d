"""Hourly counts kept up to date as the hourly files arrive."""
