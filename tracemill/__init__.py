"""Analytics over cluster workload traces, written as lazy Spark DataFrame operators."""
