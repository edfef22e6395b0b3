"""HTTP by the standard library: JSON requests and access tokens."""

from __future__ import annotations

import http.client
import json
import ssl
import urllib.error
import urllib.parse
import urllib.request
from typing import Any

from parcelflow.sources.config import OAUTH_TOKEN_PATH, SECURE_TOKEN_PATH, ServiceConfig, ServiceError

#: To connect, and to wait for each part of an answer.
CONNECT_S, READ_S = 10, 60
#: Answers of the secure endpoint that mean "no token here", so that the other one is tried.
NO_TOKEN = {401, 403, 404, 405, 500}
IDENTIFIER = "x-DDA-SecurityApplicationIdentifier"  # fixed value: header of the service


class _Patient:
    """A connection that may wait longer for an answer than for being made."""

    def connect(self):
        super().connect()
        self.sock.settimeout(READ_S)


class _Plain(_Patient, http.client.HTTPConnection):
    pass


class _Secure(_Patient, http.client.HTTPSConnection):
    pass


class _PlainHandler(urllib.request.HTTPHandler):
    def http_open(self, req):
        return self.do_open(_Plain, req)


class _SecureHandler(urllib.request.HTTPSHandler):
    def https_open(self, req):
        return self.do_open(_Secure, req, context=self._context)


def send(url: str, what: str, *, params=None, headers=None, form=None, body=None, verify: bool = True, forgive=frozenset()) -> Any:
    """The JSON answer; {} for a status that is forgiven."""
    if params:
        url += "?" + urllib.parse.urlencode(params)
    headers, data = dict(headers or {}), None
    if body is not None:
        data, headers["Content-Type"] = json.dumps(body).encode(), "application/json"
    elif form is not None:
        data = urllib.parse.urlencode(form).encode()
    context = ssl.create_default_context() if verify else ssl._create_unverified_context()
    opener = urllib.request.build_opener(_PlainHandler(), _SecureHandler(context=context))
    try:
        with opener.open(urllib.request.Request(url, data=data, headers=headers), timeout=CONNECT_S) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        if e.code in forgive:
            return {}
        raise ServiceError(f"{what} failed with HTTP {e.code}: {e.read(500).decode(errors='replace')}") from e
    except (OSError, ValueError) as e:
        raise ServiceError(f"{what} failed: {type(e).__name__}") from e


def access_token(config: ServiceConfig) -> str:
    """From the secure endpoint, else the OAuth one; only the latter if the configuration says so."""
    config.ensure()
    head, secret = {IDENTIFIER: config.security_application_identifier}, {"client_id": config.client_id, "client_secret": config.client_secret}

    def secure():
        return send(config.address(SECURE_TOKEN_PATH), "secure token request", headers=head, body={"grant_type": "client_credentials", **secret}, verify=config.verify_ssl, forgive=NO_TOKEN)

    def oauth():
        return send(config.address(OAUTH_TOKEN_PATH), "OAuth token request", headers=head, params={"grant_type": "client_credentials"}, form=secret, verify=config.verify_ssl)

    errors = []
    for ask in (oauth,) if config.oauth_only else (secure, oauth):
        try:
            if token := ask().get("access_token"):
                return token
        except ServiceError as e:
            errors.append(str(e))
    raise ServiceError("no access token: " + (" ".join(errors) or "no endpoint returned one"))
