"""Explicit schemas. Union-typed amounts are STRING: see ``functions.amounts``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FIELDS = (
    "struct<Account:string,Balance:string,OwnerCount:bigint,Sequence:bigint,BookDirectory:string,"
    "TakerGets:string,TakerPays:string,LowLimit:string,HighLimit:string,AMMID:string>"
)
NODE = (
    f"struct<LedgerEntryType:string,LedgerIndex:string,FinalFields:{FIELDS},"
    f"PreviousFields:{FIELDS},NewFields:{FIELDS}>"
)
META = (
    "struct<TransactionIndex:bigint,ledger_index:bigint,"
    f"AffectedNodes:array<struct<CreatedNode:{NODE},ModifiedNode:{NODE},DeletedNode:{NODE}>>>"
)
RESULT = (
    "struct<hash:string,TransactionType:string,Account:string,Flags:bigint,Fee:string,"
    "TicketSequence:bigint,date:bigint,ledger_index:bigint,inLedger:bigint,validated:boolean,"
    "TakerGets:string,TakerPays:string,OfferSequence:bigint,Expiration:bigint,Amount:string,"
    "DeliverMax:string,SendMax:string,DeliverMin:string,Destination:string,TransferRate:bigint,"
    f"Paths:array<array<struct<currency:string,issuer:string,account:string>>>,meta:{META},metaData:{META}>"
)
METADATA = f"tx_hash string, status string, ledger_index bigint, result {RESULT}"

OFFER = (
    "struct<index:string,Account:string,Sequence:bigint,BookDirectory:string,TakerGets:string,"
    "TakerPays:string,owner_funds:string,taker_gets_funded:string,taker_pays_funded:string>"
)
BOOK_SNAPSHOT = f"ledger_index bigint, ledger_hash string, side string, offers array<{OFFER}>"

FILL = (
    "struct<input:string,output:string,spent_input:string,improvement:string,improvement_bps:string,"
    "amm_input:string,amm_output:string,clob_input:string,clob_output:string>"
)
INTERVAL = (
    "struct<interval_lo:bigint,interval_hi:bigint,clob_unit_cost:string,clob_out_per_input:string,"
    "amm_marginal_lo:string,amm_marginal_hi:string>"
)
SAME_FILL = (
    "tx_hash string, analysis_layer string, layer1_measurement string, objective string, gain_side string, "
    "source_intent_family string, optimizer_mode string, found_improvement boolean, improvement_type string, "
    f"baseline {FILL}, best {FILL}, "
    "counterfactual_comparison struct<status:string,delta_input:string,delta_output:string,"
    "input_saved:string,delta_bps:string>, "
    "gain_decomposition struct<amm_multi_slice_fee_compounding_gain:string,"
    "allocation_optimization_gain:string,total_gain:string,"
    "amm_multi_slice_fee_compounding_gain_bps:string,allocation_optimization_gain_bps:string,"
    "total_gain_bps:string>, "
    "amm_one_shot_diagnostic struct<explained_by_amm_one_shot:boolean>, "
    f"best_point_diagnostic struct<side:string,point_units:bigint,matched_interval:{INTERVAL},"
    f"intervals_sample:array<{INTERVAL}>>, "
    "best_price_certificate struct<claim:string,domain_coverage_complete:boolean,"
    "certified_interval_count:bigint,uncertified_interval_count:bigint,"
    "uncertified_intervals:array<struct<status:string>>>, "
    "baseline_fit struct<status:string,strict_exact_match:boolean>"
)

PAIRS = (
    "ledger_start bigint, ledger_end bigint, counter_currency string, counter_issuer string, "
    "pairs array<struct<pair:string,pair_label:string,base_label:string,base_currency:string,"
    "base_issuer:string,base_currency_candidates:array<string>,counter_currency:string,"
    "counter_issuer:string,ledger_start:bigint,ledger_end:bigint,window:string>>"
)


class MissingColumns(ValueError):
    """A source lacks columns its reader needs."""


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...], source: str = "input") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumns(f"{source} lacks columns {missing}")
    return df


def parsed(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
