"""The built-in registry of record types, and loading of further ones.

Field-level schemas are data: ``load_types`` reads them from a folder of JSON files,
each holding a Spark ``StructType``. The contract family is built in as an example.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliary.operators.classify import TypeNode
from foliary.schema import field

# Type keys in registry order, each with its first parent ("-" for a root).
REGISTRY = """
base_FinancialDocument -
cloud_CloudServiceAgreement contracts_CustomerAgreement
contracts_Agreement -
contracts_CommercialAgreement contracts_Agreement
contracts_CustomerAgreement contracts_CommercialAgreement
contracts_DataProtectionAddendum contracts_CommercialAgreement
contracts_EmploymentAgreement contracts_Agreement
contracts_EmploymentContract contracts_EmploymentAgreement
contracts_LicenseAgreement contracts_CommercialAgreement
corporate_AnnualReport corporate_CorporateDocument
corporate_ArticlesOfIncorporation corporate_CorporateRegistrationDocument
corporate_ArticlesOfOrganization corporate_CorporateRegistrationDocument
corporate_BoardMeetingMinutes corporate_CorporateDocument
corporate_CanadianArticlesOfIncorporation corporate_ArticlesOfIncorporation
corporate_CertificateOfIncorporation corporate_CorporateRegistrationDocument
corporate_CorporateAmendment corporate_CorporateRegistrationDocument
corporate_CorporateBylaws corporate_CorporateDocument
corporate_CorporateDissolution corporate_CorporateDocument
corporate_CorporateDocument -
corporate_CorporateMinutes corporate_CorporateDocument
corporate_CorporateRegistrationDocument corporate_CorporateDocument
corporate_DirectorResolution corporate_CorporateDocument
corporate_DispositionOfBusinessDocument corporate_CorporateDocument
corporate_ShareCertificate corporate_CorporateDocument
corporate_ShareholderAgreement corporate_CorporateDocument
corporate_ShareholderResolution corporate_CorporateDocument
corporate_USArticlesOfIncorporation corporate_ArticlesOfIncorporation
credit_card_application_CreditCardApplication contracts_CommercialAgreement
data_sharing_DataProtectionAddendum contracts_CommercialAgreement
data_sharing_DataSharingAgreement contracts_CommercialAgreement
due_diligence_areas_DiligenceAreaMapping -
financial_FinancialStatement base_FinancialDocument
hr_BackgroundCheckConsent hr_HRDocument
hr_BenefitsEnrollmentForm hr_HRDocument
hr_BenefitsGuide hr_HRDocument
hr_CodeOfConduct hr_WorkplacePolicy
hr_CompensationStructure hr_HRDocument
hr_ComplianceDocument hr_HRDocument
hr_ConfidentialityAgreement hr_HRAgreement
hr_EmployeeHandbook hr_HRDocument
hr_EmployeeRecord hr_HRDocument
hr_ExitInterviewForm hr_HRDocument
hr_GrievanceForm hr_HRDocument
hr_HRAgreement contracts_Agreement
hr_HRDocument -
hr_InterviewEvaluation hr_HRDocument
hr_JobApplication hr_HRDocument
hr_JobDescription hr_HRDocument
hr_OfferLetter hr_HRAgreement
hr_OnboardingPacket hr_HRDocument
hr_PerformanceAppraisal hr_HRDocument
hr_PerformanceImprovementPlan hr_HRDocument
hr_Resume hr_HRDocument
hr_SeveranceAgreement hr_HRAgreement
hr_StockOptionAgreement hr_HRAgreement
hr_TaxForm hr_HRDocument
hr_TerminationLetter hr_HRDocument
hr_TrainingDevelopmentPlan hr_HRDocument
hr_WorkplacePolicy hr_HRDocument
iaas_contract_IaasCustomerAgreement cloud_CloudServiceAgreement
legal_SoftwareLicenseAgreement contracts_LicenseAgreement
service_orders_TermLetter contracts_CommercialAgreement
stock_options_StockOptionAgreement contracts_Agreement
tax_AnalyticalDocument tax_TaxDocument
tax_AuditHistory tax_AnalyticalDocument
tax_AuditWorkpaper tax_AnalyticalDocument
tax_ComplianceDocument tax_TaxDocument
tax_CorporateTaxReturn tax_TaxReturn
tax_CustomsDocument tax_ComplianceDocument
tax_PassthroughTaxReturn tax_TaxReturn
tax_ProfessionalTaxAdvisoryDocument tax_TaxDocument
tax_ProfessionalTaxOpinion tax_ProfessionalTaxAdvisoryDocument
tax_PropertyTaxDocument tax_ComplianceDocument
tax_TaxAgreement tax_TaxDocument
tax_TaxAssessment tax_TaxAuthorityDocument
tax_TaxAudit tax_TaxAuthorityDocument
tax_TaxAuthorityCorrespondence tax_TaxAuthorityDocument
tax_TaxAuthorityDocument tax_TaxDocument
tax_TaxComplianceCalendar tax_ComplianceDocument
tax_TaxDispute tax_TaxDocument
tax_TaxDocument -
tax_TaxIncentiveDocument tax_ComplianceDocument
tax_TaxNotice tax_TaxAuthorityDocument
tax_TaxPlanningDocument tax_AnalyticalDocument
tax_TaxProvisionDocument tax_AnalyticalDocument
tax_TaxReservesAnalysis tax_AnalyticalDocument
tax_TaxReturn tax_ComplianceDocument
tax_TaxRiskAssessment tax_AnalyticalDocument
tax_TaxRuling tax_TaxAuthorityDocument
tax_TaxSettlement tax_TaxAgreement
tax_TransferPricingDocument tax_AnalyticalDocument
tax_W8BenDocument tax_ComplianceDocument
"""


def registry(keywords: dict[str, tuple[str, ...]] | None = None) -> list[TypeNode]:
    """All built-in types; ``keywords`` gives the words of the built-in chooser."""
    words = keywords or {}
    nodes = []
    for line in REGISTRY.split("\n"):
        if line:
            key, parent = line.split()
            nodes.append(TypeNode(key, None if parent == "-" else parent, words.get(key, ())))
    return nodes


# Fields of the basic contract types.
AGREEMENT = T.StructType([
    field("agreement_title", required=True),
    field("agreement_date", "date", required=True),
    field("effective_date", "date", required=True),
    field("parties", "array<string>"),
    field("governing_law", required=True),
    field("term_description", required=True),
])
COMMERCIAL_AGREEMENT = T.StructType([
    *AGREEMENT.fields,
    field("payment_terms"), field("termination_provisions"), field("confidentiality_provisions"),
])
CUSTOMER_AGREEMENT = T.StructType([
    *COMMERCIAL_AGREEMENT.fields,
    field("provider_name", required=True), field("customer_name", required=True),
    field("start_date", "date"), field("end_date", "date"), field("auto_renews", "boolean"), field("renewal_terms"),
])
LICENSE_AGREEMENT = T.StructType([
    *COMMERCIAL_AGREEMENT.fields,
    field("licensor", required=True), field("licensee", required=True), field("license_scope"),
    field("license_restrictions", "array<string>"), field("license_fee"), field("license_term"),
])
EMPLOYMENT_AGREEMENT = T.StructType([
    *AGREEMENT.fields,
    field("employer", required=True), field("employee", required=True), field("start_date", "date"),
    field("compensation_description", required=True),
])
RECORD_TYPES = {
    "contracts_Agreement": AGREEMENT,
    "contracts_CommercialAgreement": COMMERCIAL_AGREEMENT,
    "contracts_CustomerAgreement": CUSTOMER_AGREEMENT,
    "contracts_LicenseAgreement": LICENSE_AGREEMENT,
    "contracts_EmploymentAgreement": EMPLOYMENT_AGREEMENT,
}


def load_types(spark: SparkSession, folder: str) -> dict[str, T.StructType]:
    """Record types from ``{type_key}.json`` files with a ``StructType`` each (a catalog, so small)."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.json$", 1).alias("key"), "value"
    )
    return {r.key: T.StructType.fromJson(json.loads(r.value)) for r in rows.collect()}


def type_table(spark: SparkSession, tree: list[TypeNode]) -> DataFrame:
    """(type_key, class_name, parent_key, position) of a registry."""
    rows = [(n.key, n.class_name, n.parent, i) for i, n in enumerate(tree)]
    return spark.createDataFrame(rows, "type_key string, class_name string, parent_key string, position int")
