"""Tables in and out: inputs, records, profiles, results and fitted models."""
