"""Explicit schemas of the canonical tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
_S, _D, _B, _TS = T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TENDER = struct(
    expediente=_S,
    contracting_body=_S,
    title=_S,
    cpv_codes=T.ArrayType(_S),
    budget_with_vat=MONEY,
    budget_without_vat=MONEY,
    estimated_value=MONEY,
    contract_type=_S,
    procedure_type=_S,
    status=_S,
    submission_deadline=_TS,
    location=_S,
    pcap_url=_S,
    ppt_url=_S,
    platform_url=_S,
    published_at=_TS,
    updated_at_source=_TS,
)

TENDER_COLUMNS = TENDER.fieldNames()

PROVIDER = struct(
    provider_id=_S,
    description=_S,
    cpv_codes=T.ArrayType(_S),
    min_budget=MONEY,
    max_budget=MONEY,
    annual_revenue=MONEY,
    certifications=T.ArrayType(_S),
    locations=T.ArrayType(_S),
)

CITATION = struct(clause=_S, page=T.IntegerType(), quote=_S)
CERTIFICATION = struct(name=_S, role=_S, citation=CITATION)
CRITERION = struct(name=_S, points=_D, is_price=_B)

EXTRACTION = struct(
    economic_solvency=struct(minimum_annual_turnover_eur=_D, description=_S, citation=CITATION),
    technical_solvency=struct(minimum_amount_eur=_D, description=_S, citation=CITATION),
    certifications=T.ArrayType(CERTIFICATION),
    award_criteria=struct(total_points=_D, criteria=T.ArrayType(CRITERION), citation=CITATION),
    guarantees=struct(
        provisional_required=_B, definitive_percentage=_D, description=_S, citation=CITATION
    ),
    execution_deadline=struct(
        description=_S, extensions_allowed=_B, extensions_description=_S, citation=CITATION
    ),
    submission_deadline=struct(description=_S, citation=CITATION),
    subcontracting=struct(allowed=_B, description=_S, citation=CITATION),
    lots=struct(
        divided_into_lots=_B, can_bid_partial_lots=_B, description=_S, citation=CITATION
    ),
)

# The older stored shape: certification names plus one citation for all of them.
EXTRACTION_OLD = T.StructType(
    [f for f in EXTRACTION.fields if f.name not in ("certifications", "execution_deadline")]
    + [
        T.StructField("certifications", T.ArrayType(_S)),
        T.StructField("certifications_citation", CITATION),
        T.StructField("execution_deadline", struct(description=_S, citation=CITATION)),
    ]
)

CITATION_BLOCKS = (
    "economic_solvency",
    "technical_solvency",
    "award_criteria",
    "guarantees",
    "execution_deadline",
    "submission_deadline",
    "subcontracting",
    "lots",
)

# One syndicated notice; namespaces are ignored by the reader. Every element may be
# repeated and is read as an array, or the reader would keep the last one.
def many(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(struct(**fields))


_M = T.ArrayType(_S)
_DOCUMENT = many(Attachment=many(ExternalReference=many(URI=_M)))
ENTRY = struct(
    id=_S,
    link=many(_href=_S, _rel=_S),
    updated=_M,
    ContractFolderStatus=many(
        ContractFolderID=_M,
        ContractFolderStatusCode=_M,
        LocatedContractingParty=many(Party=many(PartyName=many(Name=_M))),
        ProcurementProject=many(
            Name=_M,
            TypeCode=_M,
            BudgetAmount=many(TotalAmount=_M, TaxExclusiveAmount=_M, EstimatedOverallContractAmount=_M),
            RequiredCommodityClassification=many(ItemClassificationCode=_M),
            RealizedLocation=many(CountrySubentity=_M),
        ),
        TenderingProcess=many(
            ProcedureCode=_M,
            TenderSubmissionDeadlinePeriod=many(EndDate=_M, EndTime=_M),
        ),
        LegalDocumentReference=_DOCUMENT,
        TechnicalDocumentReference=_DOCUMENT,
        ValidNoticeInfo=many(
            AdditionalPublicationStatus=many(AdditionalPublicationDocumentReference=many(IssueDate=_M))
        ),
    ),
)

FEED = struct(link=many(_href=_S, _rel=_S), entry=T.ArrayType(ENTRY))
