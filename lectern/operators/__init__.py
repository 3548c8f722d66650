"""DataFrame operators. None of them runs a job unless its description says so."""
