"""Radio-coverage analytics on Spark: measurement ingest, map sampling, link
features, expert ensembles, uncertainty and evaluation reports."""
