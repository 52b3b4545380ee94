"""Process mining on Spark: event logs to footprints, workflow nets and causal nets."""
