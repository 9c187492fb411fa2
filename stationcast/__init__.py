"""stationcast: station time-series features, forecasts and profiling on PySpark."""
