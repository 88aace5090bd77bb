"""Fixed values shared by several operators.

Everything in this module must equal the published behaviour for results to be
right: word lists, tables and limits, each in its natural order.
"""

# Hosts that may be reached without encryption.
LOCAL_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "[::1]"]

# Words in a path that mark a file as handling health data.
PHI_PATH_WORDS = ["fhir", "patient", "hl7", "clinical", "health", "medical", "ehr", "phi", "hipaa"]

# Words in a bucket name that mark health data.
PHI_BUCKET_WORDS = ["patient", "phi", "ehr", "clinical", "health", "fhir", "medical", "hipaa"]

# Words in a route that mark health data.
PHI_ROUTE_WORDS = ["patient", "fhir", "clinical", "encounter", "claim", "medication", "observation",
                   "diagnosis", "condition", "allergy", "immunization", "procedure", "coverage"]

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

# Services with a business associate agreement by default.
BAA_COVERED = ["*.amazonaws.com", "*.azure.com", "*.azure-api.net", "*.google.com", "*.googleapis.com",
               "*.twilio.com", "*.salesforce.com", "*.redoxengine.com", "*.1up.health",
               "*.snowflakecomputing.com", "*.databricks.com", "*.supabase.co", "*.mongodb.net",
               "*.openai.com", "*.anthropic.com"]

# Services without one by default.
BAA_NONE = ["*.sentry.io", "*.logrocket.com", "*.mixpanel.com", "*.hotjar.com", "*.intercom.io"]

# Source and sink kinds of a data-flow path.
SOURCE_KINDS = ["db-query", "db-stored-proc", "fhir-read", "fhir-search", "fhir-bulk", "cda", "hl7-v2",
                "cds-hook", "smart-launch", "api-response", "function-param", "file-read", "env-config"]
SINK_KINDS = ["log", "error-tracking", "apm", "response", "external-api", "webhook", "cache", "storage",
              "search-index", "analytics", "queue", "notification", "document-gen", "template-render"]
MECHANISMS = ["direct", "event-emit", "middleware-next", "queue-publish", "callback", "fhir-bundle-unwrap"]
RUNTIME_KINDS = ["event-emit", "event-listen", "middleware-chain", "queue-publish", "queue-subscribe"]

# Sink kinds from least to most severe.
SINK_ORDER = ["cache", "search-index", "storage", "template-render", "document-gen", "queue", "notification",
              "response", "apm", "log", "error-tracking", "analytics", "webhook", "external-api"]

# Source kinds from least to most specific.
SOURCE_ORDER = ["env-config", "file-read", "function-param", "api-response", "smart-launch", "cds-hook",
                "cda", "db-stored-proc", "db-query", "hl7-v2", "fhir-search", "fhir-bulk", "fhir-read"]

# Sinks whose endpoint is checked against the agreement registry.
EXTERNAL_SINKS = ["external-api", "webhook", "storage", "analytics", "error-tracking", "notification"]

# Function names that make data safe.
BUILTIN_SAFE = [("redact*", "sanitizer"), ("mask*", "sanitizer"), ("sanitize*", "sanitizer"),
                ("toPublic*", "sanitizer")]

# Packages that mark a file as a likely source or sink.
SOURCE_PACKAGES = ["fhir.js", "fhirclient", "@asymmetrik/node-fhir-server-core", "@medplum/core", "hl7",
                   "node-hl7-complete", "simple-hl7", "blue-button", "cda-parser", "cds-hooks"]
SINK_PACKAGES = ["winston", "bunyan", "pino", "log4js", "axios", "node-fetch", "got", "superagent", "sentry",
                 "@sentry/node", "bugsnag", "rollbar", "mixpanel", "segment", "analytics-node", "redis",
                 "ioredis", "kafkajs", "amqplib", "sqs-consumer", "nodemailer", "sendgrid", "twilio",
                 "elasticsearch", "@elastic/elasticsearch", "newrelic", "dd-trace",
                 "@datadog/native-appsec"]

# Directories, endings and names a corpus scan leaves out.
SKIP_DIRS = ["node_modules", ".git", "dist", "build", "__pycache__", "vendor", ".next", "coverage"]
SKIP_ENDINGS = [".min.js", ".map", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2",
                ".ttf", ".eot", ".pdf", ".zip", ".tar", ".gz", ".lock"]
SKIP_NAMES = ["package-lock.json", "pnpm-lock.yaml", "composer.lock", "gemfile.lock", "pipfile.lock",
              "poetry.lock", "cargo.lock"]
MAX_FILE_BYTES = 100 * 1024
