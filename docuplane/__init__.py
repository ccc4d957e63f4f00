"""docuplane: document-obligation analytics as DataFrame operators for Spark."""
