"""Fixed values that the SQL counterparts are held to, written out: a slip in the library's own tables shows as a difference."""

# Default names of fields with health data, in reporting order.
PHI_FIELDS = [
    "patientName", "patient_name", "firstName", "lastName", "fullName",
    "address", "zipCode", "zip",
    "dateOfBirth", "dob", "birthDate", "birth_date",
    "fax", "faxNumber", "fax_number",
    "phone", "phoneNumber",
    "email",
    "ssn", "socialSecurityNumber", "social_security",
    "mrn", "medicalRecordNumber", "medical_record_number",
    "memberId", "member_id", "subscriberId",
    "beneficiaryId", "beneficiary_id", "healthPlanId", "health_plan_id",
    "licenseNumber", "license_number", "certificateNumber", "certificate_number",
    "driverLicense", "drivers_license",
    "accountNumber", "account_number", "bankAccount", "bank_account",
    "personalUrl", "personal_url", "profileUrl", "profile_url",
    "ipAddress", "ip_address", "clientIp", "client_ip", "remoteAddr", "remote_addr",
    "biometric", "fingerprint", "faceId", "retinalScan", "voicePrint",
    "vin", "vehicleId", "vehicle_id", "licensePlate", "license_plate",
    "deviceId", "device_id", "serialNumber", "serial_number", "udid", "imei",
    "diagnosis", "icdCode", "icd_code", "cptCode", "cpt_code",
    "medication", "prescription", "labResult", "lab_result",
    "procedure", "treatment", "condition",
    "Patient", "Condition", "Observation", "MedicationRequest",
    "DiagnosticReport", "Encounter", "AllergyIntolerance",
    "Immunization", "Procedure", "CarePlan",
    "insuranceId", "insurance_id", "policyNumber", "groupNumber",
    "npi", "providerNpi",
]

# Everyday words among the fields; they need an access context.
BROAD_FIELDS = ["email", "phone", "address", "name", "condition", "procedure", "medication",
                "treatment", "status", "type", "code"]

# Database tables with health data.
PHI_TABLES = ["patient", "patients", "encounter", "encounters", "diagnosis", "medication", "observation",
              "condition", "allergy", "immunization", "procedure", "claim", "claims", "claim_line",
              "coverage", "person", "member", "explanation_of_benefits", "consent", "care_team",
              "practitioner"]

# ORM models over those tables.
PHI_MODELS = ["Patient", "Patients", "Encounter", "Encounters", "Diagnosis", "Medication", "Observation",
              "Condition", "Allergy", "Immunization", "Procedure", "Claim", "Claims", "Coverage", "Person",
              "Member", "Consent", "CareTeam", "Practitioner"]

# FHIR resources that need a field restriction when searched.
FHIR_RESOURCES = ["Patient", "Person", "RelatedPerson", "Practitioner", "Condition", "Observation",
                  "DiagnosticReport", "MedicationRequest", "AllergyIntolerance", "Encounter",
                  "Immunization", "Procedure", "CarePlan", "Coverage"]

# Services with a business associate agreement by default.
BAA_COVERED = ["*.amazonaws.com", "*.azure.com", "*.azure-api.net", "*.google.com", "*.googleapis.com",
               "*.twilio.com", "*.salesforce.com", "*.redoxengine.com", "*.1up.health",
               "*.snowflakecomputing.com", "*.databricks.com", "*.supabase.co", "*.mongodb.net",
               "*.openai.com", "*.anthropic.com"]

# Services without one by default.
BAA_NONE = ["*.sentry.io", "*.logrocket.com", "*.mixpanel.com", "*.hotjar.com", "*.intercom.io"]
