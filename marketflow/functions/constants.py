"""Fixed values of the ledger data format and of the published result tables."""

# Asset encoding.
NATIVE = "XRP"
DROPS_PER_UNIT = 1_000_000
MANTISSA_DIGITS = 16
ZERO_EXPONENT = -100
EXPONENT_MIN = -96
EXPONENT_MAX = 80
NATIVE_PATH_CURRENCY = "0000000000000000000000000000000000000000"

# Account reserve in drops.
RESERVE_BASE = 1_000_000
RESERVE_PER_OBJECT = 200_000

# Seconds between 1970-01-01 and the ledger epoch 2000-01-01 UTC.
EPOCH_OFFSET = 946_684_800

# Transaction flag bits.
PAYMENT_NO_DIRECT = 0x00010000
PAYMENT_PARTIAL = 0x00020000
PAYMENT_LIMIT_QUALITY = 0x00040000
OFFER_PASSIVE = 0x00010000
OFFER_IMMEDIATE_OR_CANCEL = 0x00020000
OFFER_FILL_OR_KILL = 0x00040000
OFFER_SELL = 0x00080000
CANONICAL_SIGNATURE = 0x80000000

# Transfer rate 1.0 and its upper bound.
RATE_ONE = 1_000_000_000
RATE_MAX = 2_000_000_000

# Pool fee scale (fee units per 1) and largest fee.
FEE_SCALE = 100_000
FEE_MAX = 1_000

# Relative-error buckets in report order.
ERROR_BUCKETS = (
    ("=0", 0.0),
    ("<= 1e-15", 1e-15),
    ("<= 1e-14", 1e-14),
    ("<= 1e-13", 1e-13),
    ("<= 1e-12", 1e-12),
    ("<= 1e-9", 1e-9),
)
ERROR_ABOVE = "> 1e-9"
ERROR_UNDEFINED = "undefined(real=0, model!=0)"

# Same-fill measurements in report order.
MEASUREMENTS = (
    "fixed_input_same_input",
    "fixed_input_same_output",
    "fixed_output_same_input",
    "fixed_output_same_output",
    "bounded_partial_same_input",
    "bounded_partial_same_output",
)

# Improvement types.
GAIN_NONE = "none"
GAIN_ALLOCATION = "allocation_changed"
GAIN_COMPOUNDING = "amm_multi_slice_fee_compounding"
GAIN_BOTH = "allocation_and_amm_multi_slice_fee_compounding"
GAIN_ALLOCATION_OVER_LOSS = "allocation_changed_offsets_amm_multi_slice_fee_compounding_loss"
GAIN_COMPOUNDING_OVER_LOSS = "amm_multi_slice_fee_compounding_offsets_allocation_loss"

# Claims that mean a result carries no certificate.
UNCERTIFIED_CLAIMS = ("not_certified", "missing")
