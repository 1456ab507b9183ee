"""The retry policy, shared by what makes calls and what reports on them (fixed values)."""

RETRYABLE_CODES = (429, 500, 502, 503, 504)
MAX_RETRIES = 5
BASE_DELAY_S = 1.0
MAX_DELAY_S = 30.0
MAX_JITTER = 0.1
