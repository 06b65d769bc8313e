"""Declared schemas: readers use them instead of inference, absent inputs become empty frames of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}


def schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in columns.items()])


PROVIDER_CORE = schema(npi="long", entity="int", pfname="string", pmname="string", plname="string", plocstatename="string", ploczip="string", pmailstatename="string", pmailzip="string")
TAXONOMY = schema(npi="long", seq="int", ptaxcode="string")
CENTROIDS = schema(zcta5="string", intptlat="double", intptlong="double")
SCORED = schema(npi="long", LALVOTERID="string", match_prob="double", state_agree="boolean", zip_dist="double", full_name_sim="double", n="long", year="int")
PANEL = schema(npi="long", year="int", LALVOTERID="string", match_prob="double", state_agree="boolean", zip_dist="double", full_name_sim="double", n="long", tied="boolean")
SNAPSHOTS = schema(state="string", year="int", month="int", day="int", path="string")

#: The voter columns that other analyses of the same registry expect.
VOTER_COLUMNS = (
    "LALVOTERID CommercialData_Occupation CommercialData_OccupationGroup CommercialData_OccupationIndustry County EthnicGroups_EthnicGroup1Desc Ethnic_Description "
    "FECDonors_AvgDonation FECDonors_AvgDonation_Range FECDonors_LastDonationDate FECDonors_NumberOfDonations FECDonors_PrimaryRecipientOfContributions "
    "FECDonors_TotalDonationsAmount FECDonors_TotalDonationsAmt_Range Parties_Description Residence_Addresses_CensusTract Voters_Age Voters_BirthDate Voters_Gender "
    "Residence_Addresses_State Residence_Addresses_Zip Residence_Addresses_ZipPlus4 CommercialData_Education CommercialData_EstHomeValue CommercialData_HomePurchasePrice "
    "CommercialData_EstimatedHHIncome Voters_FirstName Voters_LastName Voters_MiddleName Voters_NameSuffix"
).split()


def empty(spark: SparkSession, columns: T.StructType) -> DataFrame:
    return spark.createDataFrame([], columns)
