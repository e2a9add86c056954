"""Dimensions looked up by finding kind: display, severity, provider.

Both are constants of a few dozen rows, so joining them is always a broadcast of
a known size.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: kind, rule name, label, category, level, severity, precision, tags
# The position is the rule index of the interchange report and is append-only.
CATALOG = (
    ("aws_access_key_id", "AwsAccessKeyId", "AWS access key", "cloud credential", "error", 7.5, "very-high", ("aws",)),
    ("aws_secret_access_key", "AwsSecretAccessKey", "AWS secret access key", "cloud credential", "error", 9.5, "high", ("aws",)),
    ("github_token", "GithubToken", "GitHub token", "token", "error", 8.5, "very-high", ("github",)),
    ("openai_api_key", "OpenAiApiKey", "OpenAI API key", "API key", "error", 8.0, "high", ("api-key",)),
    ("slack_token", "SlackToken", "Slack token", "token", "error", 8.0, "very-high", ("slack",)),
    ("stripe_key", "StripeKey", "Stripe key", "API key", "error", 8.0, "high", ("stripe", "api-key")),
    ("google_api_key", "GoogleApiKey", "Google API key", "API key", "error", 7.0, "high", ("google", "api-key")),
    ("jwt", "JsonWebToken", "JWT", "token", "warning", 6.5, "medium", ("token",)),
    ("bearer_token", "BearerToken", "Bearer token", "token", "error", 7.5, "high", ("token",)),
    ("private_key_block", "PrivateKeyBlock", "Private key block", "private key", "error", 9.5, "very-high", ("private-key", "external/cwe/cwe-321")),
    ("generic_labeled_secret", "GenericLabeledSecret", "Generic credential", "credential", "warning", 6.0, "medium", ()),
    ("high_entropy", "HighEntropyString", "High-entropy string", "possible secret", "note", 3.5, "low", ()),
    ("anthropic_api_key", "AnthropicApiKey", "Anthropic API key", "API key", "error", 8.0, "very-high", ("anthropic", "api-key")),
    ("gitlab_token", "GitlabToken", "GitLab token", "token", "error", 8.5, "very-high", ("gitlab", "token")),
    ("npm_token", "NpmToken", "npm token", "token", "error", 8.5, "very-high", ("npm", "token")),
    ("pypi_token", "PypiToken", "PyPI token", "token", "error", 8.5, "very-high", ("pypi", "token")),
    ("sendgrid_api_key", "SendgridApiKey", "SendGrid API key", "API key", "error", 8.0, "very-high", ("sendgrid", "api-key")),
    ("huggingface_token", "HuggingfaceToken", "Hugging Face token", "token", "error", 7.5, "high", ("huggingface", "token")),
    ("slack_webhook_url", "SlackWebhookUrl", "Slack webhook URL", "webhook URL", "warning", 6.0, "very-high", ("slack", "webhook")),
    ("discord_webhook_url", "DiscordWebhookUrl", "Discord webhook URL", "webhook URL", "warning", 6.0, "very-high", ("discord", "webhook")),
)
BASE_TAGS = ("security", "secret", "external/cwe/cwe-798")
CUSTOM_TAGS = ("security", "secret", "custom")
CUSTOM_LEVEL, CUSTOM_SEVERITY, CUSTOM_PRECISION = "error", 7.5, "medium"
CUSTOM_CATEGORY = "possible secret"


@dataclass(frozen=True)
class Provider:
    """Who issued a credential; ``prefix`` narrows a kind, the longest one wins."""

    kind: str
    prefix: str
    provider: str
    credential: str
    manage_url: str | None = None
    needs_rotation: bool = True
    docs: tuple[str, ...] = ()


UNKNOWN = "Unknown provider"

_AWS = "https://console.aws.amazon.com/iam/"
_AWS_DOCS = ("https://docs.aws.amazon.com/IAM/latest/UserGuide/id-credentials-access-keys-update.html",)
_PAT_DOCS = (
    "https://docs.github.com/en/authentication/keeping-your-account-and-data-secure/token-expiration-and-revocation",
)
_APP_DOCS = (
    "https://docs.github.com/en/apps/using-github-apps/reviewing-and-revoking-authorization-of-github-apps",
)
_TYPE_DOCS = (
    "https://docs.github.com/en/organizations/managing-programmatic-access-to-your-organization/github-credential-types",
)
_SLACK = "https://api.slack.com/apps"
_STRIPE = "https://dashboard.stripe.com/apikeys"
_STRIPE_DOCS = ("https://docs.stripe.com/keys", "https://docs.stripe.com/keys-best-practices")
_CLAUDE = "https://platform.claude.com/"
_CLAUDE_DOCS = ("https://platform.claude.com/docs/en/manage-claude/compliance-api-access",)

# --- Fixed values: providers by kind and value prefix -----------------------------
PROVIDERS = (
    Provider("aws_access_key_id", "", "AWS", "IAM access key", _AWS, docs=_AWS_DOCS),
    Provider("aws_secret_access_key", "", "AWS", "secret access key (part of an IAM access key pair)", _AWS, docs=_AWS_DOCS),
    Provider("github_token", "", "GitHub", "token", docs=_TYPE_DOCS),
    Provider("github_token", "github_pat_", "GitHub", "fine-grained personal access token", docs=_PAT_DOCS),
    Provider("github_token", "ghp_", "GitHub", "personal access token (classic)", docs=_PAT_DOCS),
    Provider("github_token", "gho_", "GitHub", "OAuth app access token", docs=_TYPE_DOCS),
    Provider("github_token", "ghu_", "GitHub", "GitHub App user access token", docs=_APP_DOCS),
    Provider("github_token", "ghr_", "GitHub", "GitHub App refresh token", docs=_APP_DOCS),
    Provider("github_token", "ghs_", "GitHub", "GitHub App installation access token", docs=_TYPE_DOCS),
    Provider("openai_api_key", "", "OpenAI", "API key", "https://platform.openai.com/api-keys"),
    Provider("slack_token", "", "Slack", "token", _SLACK, docs=("https://docs.slack.dev/reference/methods/auth.revoke",)),
    Provider("stripe_key", "pk_", "Stripe", "publishable key", _STRIPE, False, _STRIPE_DOCS[:1]),
    Provider("stripe_key", "sk_live_", "Stripe", "secret API key", _STRIPE, docs=_STRIPE_DOCS),
    Provider("stripe_key", "rk_live_", "Stripe", "restricted API key", _STRIPE, docs=_STRIPE_DOCS),
    Provider("stripe_key", "sk_test_", "Stripe", "secret API key (test mode)", _STRIPE, docs=_STRIPE_DOCS),
    Provider("stripe_key", "rk_test_", "Stripe", "restricted API key (test mode)", _STRIPE, docs=_STRIPE_DOCS),
    Provider("google_api_key", "", "Google", "API key", "https://console.cloud.google.com/apis/credentials"),
    Provider("anthropic_api_key", "", "Anthropic", "API key", _CLAUDE, docs=_CLAUDE_DOCS),
    Provider("anthropic_api_key", "sk-ant-admin01-", "Anthropic", "Admin API key", _CLAUDE, docs=_CLAUDE_DOCS),
    Provider("gitlab_token", "", "GitLab", "token"),
    Provider("gitlab_token", "glpat-", "GitLab", "access token (personal, project or group)", docs=("https://docs.gitlab.com/user/profile/personal_access_tokens/",)),
    Provider("gitlab_token", "gldt-", "GitLab", "deploy token"),
    Provider("gitlab_token", "glrt-", "GitLab", "runner authentication token"),
    Provider("gitlab_token", "gloas-", "GitLab", "OAuth application secret"),
    Provider("npm_token", "", "npm", "access token", docs=("https://docs.npmjs.com/revoking-access-tokens",)),
    Provider("pypi_token", "", "PyPI", "API token"),
    Provider("sendgrid_api_key", "", "Twilio SendGrid", "API key", "https://app.sendgrid.com/settings/api_keys"),
    Provider("huggingface_token", "", "Hugging Face", "user access token", docs=("https://huggingface.co/docs/hub/security-tokens",)),
    Provider("slack_webhook_url", "", "Slack", "incoming webhook URL", _SLACK),
    Provider("discord_webhook_url", "", "Discord", "webhook URL", docs=("https://docs.discord.com/developers/resources/webhook",)),
)

GENERIC_CREDENTIALS = {
    "jwt": "JWT",
    "bearer_token": "bearer token",
    "private_key_block": "private key",
    "generic_labeled_secret": "labeled credential",
    "high_entropy": "high-entropy string",
}
GENERIC_CREDENTIAL = "credential"

# What to do next, in this engine's own words, by how the credential is rotated.
ROTATION_STEPS = {
    "provider": (
        "Create a replacement with the least privilege it needs and store it outside the source.",
        "Move every consumer to the replacement.",
        "Revoke the exposed credential at the provider and confirm that it is rejected.",
        "Look through the provider's activity log for use since the exposure.",
    ),
    "private_key_block": (
        "Generate a new key pair; do not reuse the exposed one.",
        "Replace the public key wherever the old one was trusted.",
        "Retire the exposed key and review access on those systems.",
    ),
    "unknown": (
        "Find out which service issued the credential.",
        "Revoke or regenerate it there; deleting it from the source is not enough.",
        "Keep the replacement in the environment or a secret manager.",
    ),
    "none": (),
}
