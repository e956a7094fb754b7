"""Multi-operator jobs: prepare, triage, evaluate, calibrate, discover."""
